"""Token/sequence operators, BLEU and CSV blank round trip."""

import os

from pyspark.sql import functions as F

from retort.operators import bleu as bl
from retort.operators import tokens as tk
from retort.sources import io


def test_span_lengths():
    assert tk.span_lengths(512, 0.15, 3.0) == (568, 114)


def test_pack_chunks_remainder(spark):
    df = spark.createDataFrame([(0, list(range(7)))], "row_id long, ids array<int>")
    out = tk.pack_chunks(df, "ids", ["row_id"], 3).orderBy("chunk").collect()
    assert [r.input_ids for r in out] == [[0, 1, 2], [3, 4, 5]]
    short = spark.createDataFrame([(0, [1, 2])], "row_id long, ids array<int>")
    assert [r.input_ids for r in tk.pack_chunks(short, "ids", ["row_id"], 3).collect()] == [[1, 2]]


def test_span_corruption_lengths(spark):
    df = spark.range(0, 20).select(F.col("id").alias("k"),
                                   F.transform(F.sequence(F.lit(1), F.lit(568)), lambda x: x + 10).alias("ids"))
    m = df.withColumn("mask", tk.span_mask(F.size("ids"), F.col("k").cast("string")))
    m = m.withColumn("inp", tk.fuse_spans("ids", tk.sentinel_ids("mask", 32100)))
    m = m.withColumn("lab", tk.fuse_spans("ids", tk.sentinel_ids(tk.invert_mask("mask"), 32100)))
    for r in m.select(F.size("mask").alias("n"), F.size(F.filter("mask", lambda x: x)).alias("noise"),
                      F.size("inp").alias("li"), F.size("lab").alias("ll")).collect():
        assert (r.n, r.noise, r.li, r.ll) == (568, 85, 512, 114)


def test_encode_decode_roundtrip(spark):
    docs = spark.createDataFrame([(1, "CC O c1ccccc1"), (2, "O=C(O)C")], "doc_id long, text string")
    p = tk.pretokenise(docs, "text")
    vocab = tk.build_vocab(tk.token_counts(p))
    enc = tk.encode(p, "pieces", vocab)
    dec = {r.doc_id: r.text for r in tk.decode(enc, "input_ids", vocab).collect()}
    assert dec == {1: "CC O c1ccccc1", 2: "O=C(O)C"}


def test_pad_truncate_keeps_eos(spark):
    df = spark.createDataFrame([([5, 6, 7, 1],), ([5, 1],)], "ids array<int>")
    out = tk.pad_truncate(df, "ids", 3).collect()
    assert out[0].input_ids == [5, 6, 1] and out[0].attention_mask == [1, 1, 1]
    assert out[1].input_ids == [5, 1, 0] and out[1].attention_mask == [1, 1, 0]


def test_bleu_identical_is_100(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat .", "the cat sat on the mat .")], "k long, h string, r string")
    r = bl.corpus_bleu(df, ["k"], "h", "r").collect()[0]
    assert abs(r.bleu - 100.0) < 1e-9


def test_csv_blank_sentinel_survives(spark):
    df = spark.createDataFrame([(" ", "CCO")], "CATALYST string, REACTANT string")
    path = io.scratch(spark, "blank")
    io.sink_csv(df, path)
    back = io.scan_csv(spark, path, df.schema).collect()[0]
    assert back.CATALYST == " " and back.REACTANT == "CCO"


def test_scan_by_extension_rejects_unknown(spark):
    import pytest
    with pytest.raises(ValueError):
        io.scan_by_extension(spark, "/nonexistent/file.xml")


def test_inline_row(spark):
    df = io.inline_row(spark, "REACTANT:CCOREAGENT: ")
    assert df.columns == ["input"] and df.collect()[0].input == "REACTANT:CCOREAGENT: "


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arrow_batches_are_bounded_by_bytes(spark):
    from retort.session import BATCH_BYTES, small_batches
    before = spark.conf.get(BATCH_BYTES)
    small_batches(spark, 1 << 20)
    try:
        def sizes(batches):
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

        rows = spark.range(9000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("t"))
        assert max(r["size"] for r in rows.mapInArrow(sizes, "size long").collect()) < 2 << 20
    finally:
        spark.conf.set(BATCH_BYTES, before)


def test_queries_bound_their_batches(spark, monkeypatch):
    import __spark_entry__
    from retort import session
    seen = []
    monkeypatch.setattr(session, "small_batches", seen.append)
    __spark_entry__._shipped(lambda s, d: None)(spark, "")
    assert seen == [spark]


def test_pieces_are_counted_in_the_pass_that_makes_them(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("",), ("b",)], "text string").coalesce(1)
    counts = tk.token_counts(tk.pretokenise(df, "text"))
    assert "_batch_counts(run(text" in _plan(counts)
    assert {r.token: r.n for r in counts.collect()} == {"▁a": 2, "▁b": 2, "▁": 1}
    plain = spark.createDataFrame([(["x", None, "x"],), ([],), (None,)], "pieces array<string>")
    assert [tuple(r) for r in tk.token_counts(plain).collect()] == [("x", 2)]


def test_sentinels_and_masks_are_array_passes(spark):
    masks = [[True, True, False, True], [False, True], [], [True], None, [False, False, True, True, False, True]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, mask array<boolean>").coalesce(1)
    got = df.select("i", tk.sentinel_ids("mask", 100).alias("s"))
    assert "transform(" not in _plan(got)
    assert [r.s for r in got.orderBy("i").collect()] == [[99, -1, 0, 98], [0, 99], [], [99], None, [0, 0, 99, -1, 0, 98]]
    lengths = spark.createDataFrame([(n, f"{n}|x") for n in (2, 3, 20, 568)] + [(None, "k")], "n int, k string").coalesce(1)
    made = lengths.select("n", tk.span_mask(F.col("n"), F.col("k")).alias("m"))
    assert "aggregate(" not in _plan(made)
    rows = {r.n: r.m for r in made.collect()}
    assert rows[None] is None and {n: len(m) for n, m in rows.items() if n} == {n: n for n in (2, 3, 20, 568)}
    assert all(sum(m) == max(round(n * 0.15), 1) and not m[0] and m[-1] for n, m in rows.items() if n)
