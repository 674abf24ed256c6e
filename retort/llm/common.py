"""Small helpers shared by the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null becomes empty); other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """The identity of a whole text: 16 bytes of MD5."""
    return F.unhex(F.md5(text))


def session_size(df: DataFrame) -> int:
    """Shuffle partitions of the session: what row groups are sized by."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
