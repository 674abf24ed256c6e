"""Incremental parsing of raw reaction files with Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.plans.corpora import clean_reactions
from retort.schema import RAW_REACTIONS
from retort.session import checkpoint_dir


def read_raw_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Headerless TSV files (id, input, product, condition) as a stream."""
    r = (spark.readStream.schema(RAW_REACTIONS).option("sep", "\t").option("header", False)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(input_dir)


def clean_stream(raw: DataFrame, mode: str = "strict") -> DataFrame:
    """Stateless: the same expressions as the batch parser; the id stays the row key."""
    keyed = raw.withColumn("row_id", F.col("id"))
    return clean_reactions(keyed, mode=mode)


def start_clean_stream(spark: SparkSession, input_dir: str, output_dir: str, name: str = "clean-reactions",
                       available_now: bool = True, checkpoint: str | None = None):
    """Parse every new raw file into Parquet.  Exactly-once through the file
    sink and a checkpoint in the shared checkpoint folder (not a local temp dir)."""
    ck = checkpoint or os.path.join(checkpoint_dir(spark), "streams", name)
    q = (clean_stream(read_raw_stream(spark, input_dir)).writeStream.format("parquet")
         .option("path", output_dir).option("checkpointLocation", ck).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()
