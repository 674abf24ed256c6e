"""The registered queries on the test tables, and the pipeline against its parts."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.mark.parametrize("name", ["op2_maximal_repeats", "op4_chosen_path_join", "op10_chat_snapshots",
                                  "op11_dual_tree_codes", "op12_line_resample", "op13_zstd_warc"])
def test_query_matches_sql(spark, name):
    from tools.oracle_check import check
    res = check(spark, SF, [name], verbose=False)[name]
    assert res[0] == "ok", res


def test_all_queries_are_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


def test_pipeline_matches_a_plain_version(spark):
    import corpus_pipeline as C
    from retort.llm import packing, qualify, secrets
    from tests.llm.test_operators import groups_by_force
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = qualify.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in qualify.score(docs, weights).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    keep = {c for _, c, _, _ in groups_by_force(sorted(texts.items()))}
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(" ".join(b) in " ".join(t.lower().split()) for b in bench)
    left = {i: texts[i] for i in keep if not holds(texts[i])}
    clean = {i: secrets.redact(t, s, "[secret]") if (s := secrets.find(t)) else t for i, t in left.items()}
    want = spark.createDataFrame(sorted(clean.items()), "doc_id long, text string")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    expected = {tuple(r) for r in packing.pack_documents(want).select(columns).collect()}
    out = C.run(spark, SF)
    got = {tuple(r) for r in out.select(columns).collect()}
    assert got == expected
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
