"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept.  All but the last return the columns of ``documents``; the
last returns one row per packed piece.  ``run`` writes every stage as Parquet
under the shared checkpoint folder and reads it again for the next, so a lost
executor costs at most one stage, and drops what has been read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import decontaminate, packing, qualify, secrets, setjoin
from retort.llm.common import DOC_COLUMNS, table
from retort.session import drop_path, ship, stage_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    ship(spark)
    weights = qualify.fit(docs, table(spark, sf_dir, "labels"))
    return qualify.keep(docs.select(*DOC_COLUMNS), weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at a similarity of 0.8 or more."""
    ship(spark)
    return setjoin.one_of_each(docs.select(*DOC_COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs.select(*DOC_COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    ship(spark)
    return secrets.without_secrets(docs.select(*DOC_COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secret_removal), ("packing", best_fit)]

ORACLE_SQL = None  # packing and tiling are not expressible; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = f"pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = stage_path(spark, f"{folder}/{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
