"""Checks for exact positions: splits, folds, samples, oversampling, slices, positional joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.operators import joins as jn
from retort.plans import rowindex as ri
from retort.sources import testdata as td
from retort.suite import register
from retort.suite.reactions import FWD, clean
from retort.plans import corpora

W = td.with_sql
LABELS = "fx_labels AS (SELECT doc_id, quality AS target FROM labels)"


@register("split_train_valid_test", W(*FWD) + """
 , ranked AS (SELECT row_id, row_number() OVER (ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) - 1 AS idx,
                     count(*) OVER () AS n FROM fx_fwd)
 SELECT row_id, CASE WHEN idx < floor(n * 0.1) THEN 'test' WHEN idx < 2 * floor(n * 0.1) THEN 'valid'
                     ELSE 'train' END AS split FROM ranked""")
def _split_tvt(spark, sf):
    fwd = ri.written(corpora.forward_corpus(clean(spark, sf)))
    return ri.split_train_valid_test(fwd, ["row_id"], seed=42, frac=0.1).select("row_id", "split")


@register("split_fraction", W(LABELS) + """
 , ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx,
                     count(*) OVER () AS n FROM fx_labels)
 SELECT doc_id, CASE WHEN idx < ceil(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def _split_fraction(spark, sf):
    return ri.split_fraction(td.labels_fx(spark, sf), ["doc_id"], seed=7, test_size=0.1).select("doc_id", "split")


@register("split_head_percent", """
 WITH ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
 SELECT doc_id, CASE WHEN idx < round_even(n * 0.05, 0) THEN 'validation' ELSE 'train' END AS split FROM ranked""")
def _split_head_percent(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id")
    return ri.split_head_percent(docs, ["doc_id"], pct=5.0)


@register("shuffle_rows", W(LABELS) + """
 SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx FROM fx_labels""")
def _shuffle_rows(spark, sf):
    return ri.shuffle_rows(td.labels_fx(spark, sf), ["doc_id"], seed=42).select("doc_id", "idx")


@register("sample_fraction", W(LABELS) + """
 , ranked AS (SELECT doc_id, target, row_number() OVER (ORDER BY md5('3|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx,
                     count(*) OVER () AS n FROM fx_labels)
 SELECT doc_id, target FROM ranked WHERE idx < round_even(n * 0.2, 0)""")
def _sample_fraction(spark, sf):
    return ri.sample_fraction(td.labels_fx(spark, sf), ["doc_id"], frac=0.2, seed=3)


@register("sample_n", """
 SELECT o_orderkey FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000""")
def _sample_n(spark, sf):
    o = td.table(spark, sf, "orders").select("o_orderkey")
    return ri.sample_n(o, ["o_orderkey"], n=1000, seed=42)


@register("oversample_minority", W(LABELS) + """
 , mino AS (SELECT doc_id, target, row_number() OVER (ORDER BY doc_id) - 1 AS mi FROM fx_labels WHERE target = 0),
 nmin AS (SELECT count(*) AS n FROM mino),
 draws AS (SELECT CAST(('0x' || substr(md5('42|' || CAST(d AS VARCHAR)), 1, 8)) AS BIGINT) % n AS mi
           FROM (SELECT unnest(range(0, n * 10)) AS d, n FROM nmin))
 SELECT doc_id, target FROM fx_labels
 UNION ALL SELECT m.doc_id, m.target FROM draws JOIN mino m USING (mi)""")
def _oversample(spark, sf):
    return ri.oversample_minority(td.labels_fx(spark, sf), "target", 0, k=10, key_cols=["doc_id"], seed=42)


@register("batch_ids", """
 WITH ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
 SELECT doc_id, idx, CAST(floor(idx / 64) AS BIGINT) AS batch FROM ranked WHERE idx < floor(n / 64) * 64""")
def _batch_ids(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id")
    return ri.batch_ids(docs, ["doc_id"], batch_size=64, drop_last=True)


@register("stratified_folds", W(LABELS) + """
 , lab AS (SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY doc_id) - 1 AS j FROM fx_labels),
 cls AS (SELECT target, min(doc_id) AS first, count(*) AS nc FROM fx_labels GROUP BY target),
 cls2 AS (SELECT target, nc, coalesce(sum(nc) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cls),
 alloc AS (SELECT target, f, (s + nc - f + 9) // 10 - (s - f + 9) // 10 AS a FROM cls2, (SELECT range AS f FROM range(10))),
 cum AS (SELECT target, f, sum(a) OVER (PARTITION BY target ORDER BY f) AS hi FROM alloc)
 SELECT l.doc_id, l.target, CAST((SELECT count(*) FROM cum c WHERE c.target = l.target AND c.hi <= l.j) AS INTEGER) AS fold
 FROM lab l""")
def _stratified_folds(spark, sf):
    return ri.stratified_folds(td.labels_fx(spark, sf), "target", ["doc_id"], k=10)


@register("fold_filter", W(LABELS) + """
 , lab AS (SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY doc_id) - 1 AS j FROM fx_labels),
 cls AS (SELECT target, min(doc_id) AS first, count(*) AS nc FROM fx_labels GROUP BY target),
 cls2 AS (SELECT target, nc, coalesce(sum(nc) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cls),
 alloc AS (SELECT target, f, (s + nc - f + 9) // 10 - (s - f + 9) // 10 AS a FROM cls2, (SELECT range AS f FROM range(10))),
 cum AS (SELECT target, f, sum(a) OVER (PARTITION BY target ORDER BY f) AS hi FROM alloc),
 folded AS (SELECT l.doc_id, (SELECT count(*) FROM cum c WHERE c.target = l.target AND c.hi <= l.j) AS fold FROM lab l)
 SELECT doc_id, CASE WHEN fold = 0 THEN 'valid' ELSE 'train' END AS split FROM folded""")
def _fold_filter(spark, sf):
    from retort.operators.filters import fold_filter
    f = ri.stratified_folds(td.labels_fx(spark, sf), "target", ["doc_id"], k=10)
    return fold_filter(f, 0).select("doc_id", "split")


@register("head_slice", W(*FWD) + " SELECT row_id, input FROM fx_fwd ORDER BY row_id LIMIT 500")
def _head_slice(spark, sf):
    fwd = ri.written(corpora.forward_corpus(clean(spark, sf)))
    return ri.head_slice(fwd, ["row_id"], n=500).select("row_id", "input")


@register("head_slice_fraction", " SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.3)")
def _head_slice_fraction(spark, sf):
    return ri.head_slice(td.table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], frac=0.3)


@register("cap_samples", " SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _cap_samples(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id", "n_chars")
    return ri.head_slice(docs, ["doc_id"], n=100)


@register("positional_join", W(td.SQL_BEAMS) + """
 SELECT b.id AS row_id, rtrim(replace(b.seq, ' ', ''), '.') AS pred, t.target
 FROM fx_beams b JOIN (SELECT DISTINCT id, target FROM fx_beams) t ON t.id = b.id WHERE b.rank = 0""")
def _positional_join(spark, sf):
    from retort.functions.reaction import clean_generated
    b = td.beams_fx(spark, sf)
    left = b.where("rank = 0").select(F.col("id").alias("row_id"), clean_generated("seq").alias("pred"))
    right = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"),
                                                 td._pool_at(F.col("o_custkey")).alias("target"))
    return jn.positional_join(left, right, "row_id")


@register("fan_out_join", W(td.SQL_BEAMS) + " SELECT id AS o_orderkey, rank, seq FROM fx_beams")
def _fan_out_join(spark, sf):
    o = td.table(spark, sf, "orders").select("o_orderkey")
    idx = ri.global_index(o, ["o_orderkey"], index_col="row_id", total_col=None)
    b = td.beams_fx(spark, sf).join(idx.select(F.col("o_orderkey").alias("id"), "row_id"), "id")
    outputs = b.select((F.col("row_id") * 5 + F.col("rank")).alias("pos"), "seq")
    j = jn.fan_out_join(outputs, idx, k=5, pos_col="pos", index_col="row_id")
    return j.select("o_orderkey", (F.col("pos") % 5).cast("int").alias("rank"), "seq")


@register("sorted_tokens", W(td.SQL_RAW_REACTIONS) + " SELECT row_id, list_sort(string_split(input, '.')) AS tokens FROM fx_raw_reactions")
def _sorted_tokens(spark, sf):
    r = td.raw_reactions(spark, sf)
    return r.select("row_id", F.array_sort(F.split("input", r"\.")).alias("tokens"))


@register("last_per_key", W(td.SQL_BEAMS) + " SELECT id, arg_max(seq, rank) AS seq FROM fx_beams GROUP BY id")
def _last_per_key(spark, sf):
    b = td.beams_fx(spark, sf)
    return jn.last_per_key(b, "id", ["seq"], order="rank")
