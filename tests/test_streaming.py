"""The stateless parser gives the same rows on a stream as in batch."""

from retort.plans.corpora import clean_reactions
from retort.sources import io
from retort.sources import testdata as td
from retort.streaming.reactions import start_clean_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    raw = td.raw_reactions(spark, SF)
    src = io.scratch(spark, "stream-in")
    out = io.scratch(spark, "stream-out")
    io.sink_tsv(raw.select("id", "input", "product", "condition").repartition(3), src)
    q = start_clean_stream(spark, src, out, checkpoint=io.scratch(spark, "stream-ck"))
    q.awaitTermination(120)
    streamed = spark.read.parquet(out).drop("row_id")
    batch = clean_reactions(raw.select("id", "input", "product", "condition", raw.id.alias("row_id"))).drop("row_id")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
