"""dictionary_apply batch path and lookup_join policies."""

import pytest
from pyspark.sql import functions as F

from retort.operators.joins import lookup_join
from retort.plans.dictionary import compound_function, dictionary_apply, dictionary_apply_all, read_dictionary


def test_dictionary_apply_batch_function(spark):
    fn = compound_function("test_reverse", lambda s: s.str[::-1])
    df = spark.createDataFrame([(i, ["CCO", "c1ccccc1", " ", None][i % 4]) for i in range(40)], "id long, smi string")
    out = dictionary_apply(df, "smi", "rev", fn, keep=lambda c: c != F.lit(" "))
    got = {(r.smi, r.rev) for r in out.collect()}
    assert got == {("CCO", "CCO"[::-1]), ("c1ccccc1", "c1ccccc1"[::-1]), (" ", " "), (None, None)}
    assert out.count() == 40


def test_dictionary_apply_by_name_and_column_function(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert {r.y for r in dictionary_apply(df, "x", "y", "test_reverse").collect()} == {"a", "b"}
    assert {r.y for r in dictionary_apply(df, "x", "y", F.upper).collect()} == {"A", "B"}


def test_dictionary_apply_all_long_form(spark):
    """Hot rows, nulls, blanks, repeated rows, a result that is null, an empty table; rows move once whatever the number of columns."""
    fn = compound_function("test_turn", lambda s: s.str[::-1].where(s != "bad"))
    rows = [(i % 9, "CCO", "O", None if i % 2 else "N1") for i in range(300)] + [(1, None, None, None), (2, "bad", " ", "ab")]
    df = spark.createDataFrame(rows, "n long, a string, b string, c string")
    out = dictionary_apply_all(df, ["a", "b", "c"], fn, keep=lambda x: x != F.lit(" "))
    turn = lambda x: x if x in (None, " ") else None if x == "bad" else x[::-1]
    assert out.columns == df.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((r.n, turn(r.a), turn(r.b), turn(r.c))) for r in df.collect())
    assert dictionary_apply_all(df.where("n < 0"), ["a", "b"], fn).count() == 0
    joins = [dictionary_apply_all(df, cols, fn)._jdf.queryExecution().optimizedPlan().toString().count("Join")
             for cols in (["a", "b"], ["a", "b", "c"])]
    assert joins == [2, 2]


def test_stored_dictionary_computes_only_new_values(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def turn(s):
        seen.add(len(s))
        return s.str[::-1]

    fn, store = compound_function("test_counted", turn), str(tmp_path / "words")
    first = spark.createDataFrame([(1, "ab", "cd"), (2, "ab", None)], "n long, a string, b string")
    later = spark.createDataFrame([(1, "ab", "xy"), (2, "cd", "ab")], "n long, a string, b string")
    got = {(r.n, r.a, r.b) for r in dictionary_apply_all(first, ["a", "b"], fn, store=store).collect()}
    assert got == {(1, "ba", "dc"), (2, "ba", None)} and seen.value == 2
    got = {(r.n, r.a, r.b) for r in dictionary_apply_all(later, ["a", "b"], fn, store=store).collect()}
    assert got == {(1, "ba", "yx"), (2, "dc", "ba")} and seen.value == 3
    assert {r[0] for r in read_dictionary(spark, store, fn).collect()} == {"ab", "cd", "xy"}
    assert {r.z for r in dictionary_apply(later, "a", "z", fn, store=store).collect()} == {"ba", "dc"} and seen.value == 3


def test_lookup_join_missing_key_policies(spark):
    df = spark.createDataFrame([("a",), ("z",)], "smiles string")
    lk = spark.createDataFrame([("a", True, 1), ("a", False, 2)], "smiles string, pred boolean, o int")
    strict = lookup_join(df, lk.drop("o").dropDuplicates(["smiles"]), "smiles", on_missing="error")
    with pytest.raises(Exception, match="no entry for z"):
        strict.collect()
    kept = {r.smiles: r.pred for r in lookup_join(df, lk, "smiles", on_missing="keep", lookup_order="o").collect()}
    assert kept == {"a": False, "z": None}  # later row wins, missing key kept as null
    assert [r.smiles for r in lookup_join(df, lk, "smiles", on_missing="drop", lookup_order="o").collect()] == ["a"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_corpora_compute_parsed_and_canonical_text_once_a_row(spark):
    from retort.plans import corpora
    raw = spark.createDataFrame([(i, f"REACTANT:CCO.REAGENT:{'C' * (i % 3 + 1)}.SOLVENT:O", "PRODUCT:CO", "YIELD:5.0") for i in range(9)],
                                "row_id long, input string, product string, condition string")
    clean = corpora.clean_reactions(raw)
    for make, dear in ((corpora.forward_corpus, 1), (corpora.retro_corpus, 1), (corpora.yield_corpus, 3)):
        plan = _plan(make(clean))
        assert plan.count("forall(") == dear  # conditions take no copies of canonical texts along, least of all below an aggregate
        assert plan.count("INTERNAL_STANDARD) > 0") == 1  # nor of the parsed items
        assert make(clean).count() == 3


def test_forests_read_their_rows_from_a_table(spark, tmp_path):
    from retort.suite import ml_checks
    orders = [(i, i % 7, "F", 1.0, "1-URGENT") for i in range(60)]
    lines = [(i, i + k, k, "AR"[k % 2], "O") for i in range(60) for k in range(2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for make in (ml_checks._train_test, ml_checks._split_rows):
        for part in make(spark, str(tmp_path)):
            plan = _plan(part)
            assert "regexp_extract_all" not in plan and "Aggregate" not in plan
