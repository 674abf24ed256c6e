"""Readers and writers.

CSV notes (T4): Spark's CSV *writer* trims values by default, which turns
the blank role sentinel ' ' into an empty field that reads back as null.
``sink_csv`` therefore always writes with
``ignoreLeadingWhiteSpace=false`` / ``ignoreTrailingWhiteSpace=false``.
Readers take explicit schemas (no inference pass over the data).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retort.schema import RAW_REACTIONS
from retort.session import stage_path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local temp dir on a cluster)."""
    return stage_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, na_values: list | None = None) -> DataFrame:
    """Headed CSV with a declared schema (inference would read all data once more).  ``na_values``: extra strings read as null
    (pandas treats e.g. 'NA' as missing; Spark keeps it unless asked)."""
    df = (spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).option("multiLine", False).option("escape", '"').csv(path))
    for v in na_values or []:
        df = df.select(*[F.when(F.col(c) == v, None).otherwise(F.col(c)).alias(c)
                         if t == "string" else F.col(c) for c, t in df.dtypes])
    return df


def scan_tsv_named(spark: SparkSession, path: str, schema: T.StructType = RAW_REACTIONS) -> DataFrame:
    """Headerless tab-separated file with given column names/types."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", False)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def scan_lines(spark: SparkSession, path: str, name: str = "smiles") -> DataFrame:
    """One value per line, no header."""
    return spark.read.text(path).withColumnRenamed("value", name)


def scan_smi_parts(spark: SparkSession, glob: str, name: str = "smiles") -> DataFrame:
    """``.smi`` parts: first line of every file is a title; the compound is the
    first blank/tab-separated field.  The CSV reader's ``header`` option drops
    exactly the first line of each file, in parallel over the files."""
    lines = (spark.read.option("header", True).option("sep", "\u0001").option("quote", "")
             .schema("line string").csv(glob))
    first = F.element_at(F.split(F.trim(F.col("line")), r"[ \t]+"), 1)
    return lines.select(first.alias(name)).where(F.col(name).isNotNull() & (F.col(name) != ""))


def scan_by_extension(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """csv / json (with a declared schema) / txt chosen by the suffix; any other suffix is an error."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if ext in ("csv", "json", "jsonl") and schema is None:
        raise ValueError(f"a {ext} file needs a schema")
    if ext == "csv":
        return scan_csv(spark, path, schema)
    if ext in ("json", "jsonl"):
        return spark.read.schema(schema).json(path)
    if ext == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    raise ValueError(f"unsupported file extension {ext!r}: use csv, json or txt")


def pick_text_column(df: DataFrame, preferred: str = "text") -> DataFrame:
    """The ``text`` column if present, else the first column, as ``text``."""
    col = preferred if preferred in df.columns else df.columns[0]
    return df.select(F.col(col).alias("text"))


def inline_row(spark: SparkSession, value: str, name: str = "input") -> DataFrame:
    """One string as a one-row table (single-prompt prediction)."""
    return spark.createDataFrame([(value,)], T.StructType([T.StructField(name, T.StringType())]))


def sink_csv(df: DataFrame, path: str, split_col: str | None = None, mode: str = "overwrite") -> None:
    """Headed CSV; blanks survive (no trimming), quotes are doubled; one folder per split value."""
    w = (df.write.mode(mode).option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if split_col:
        w = w.partitionBy(split_col)
    w.csv(path)


def scan_split(spark: SparkSession, path: str, schema: T.StructType | str, split_col: str, value: str) -> DataFrame:
    """One split of a table that ``sink_csv`` wrote with ``split_col``: the other splits' folders are not read."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*[f for f in full if f.name != split_col], T.StructField(split_col, T.StringType())])
    return scan_csv(spark, path, full).where(F.col(split_col) == value).drop(split_col)


def sink_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("sep", "\t").option("header", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def as_matrix(c, width: int) -> Column:
    """A flat array of numbers as rows of ``width`` (a vector per token); the last row may be shorter."""
    x = F.col(c) if isinstance(c, str) else c
    rows = F.sequence(F.lit(0), F.ceil(F.size(x) / F.lit(width)).cast("int") - 1)
    return F.when(F.size(x) > 0, F.transform(rows, lambda i: F.slice(x, i * width + 1, width))).otherwise(F.array().cast(T.ArrayType(T.ArrayType(T.FloatType()))))


def sink_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keyed embeddings as Parquet: vectors (``array<float>``) or matrices (``array<array<float>>``, length x width), as they are."""
    kinds = [f.dataType for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    if not kinds:
        raise ValueError("no array column to write")
    df.write.mode(mode).parquet(path)


def read_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Embeddings written by ``sink_arrays``, with their declared schema."""
    return spark.read.schema(schema).parquet(path)


def sink_metrics_json(metrics: DataFrame, path: str, prefix: str = "eval_", mode: str = "overwrite") -> None:
    """A one-row metrics table as JSON, every name prefixed (``eval_loss``...)."""
    metrics.select(*[F.col(c).alias(prefix + c) for c in metrics.columns]).coalesce(1).write.mode(mode).json(path)


def flatten_score_batches(batches: DataFrame, batch_col: str = "batch", scores_col: str = "scores",
                          out: str = "score") -> DataFrame:
    """List-of-batches of score vectors -> one row per example, order kept as (batch, pos)."""
    return batches.select(batch_col, F.posexplode(scores_col).alias("pos", out))


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    vocab.write.mode(mode).parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_merges(merges: DataFrame, path: str, mode: str = "overwrite") -> None:
    merges.write.mode(mode).parquet(path)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
