"""Hand-made cases for parsing, string functions and corpora (FIXTURES.md §2)."""

from pyspark.sql import functions as F

from retort.functions import reaction as rx
from retort.functions import smiles as sm
from retort.plans import corpora
from retort.plans.restore import restore_roles


def one(spark, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema)


def test_parse_roles_strict_and_carry(spark):
    df = spark.createDataFrame([("1", "REACTANT:CCO.REAGENT:[Na+].[Cl-].CATALYST:[CH3:1]O", None, None, 1)],
                               "id string, input string, product string, condition string, row_id long")
    strict = corpora.clean_reactions(df, strip_maps=False).collect()[0]
    assert strict["REACTANT"] == "CCO"
    assert strict["REAGENT"] == "[Na+]"            # unlabelled fragment dropped (T1)
    assert strict["CATALYST"] == "[CH3:1]O"        # value after the first ':'
    assert strict["SOLVENT"] is None and strict["PRODUCT"] is None
    carry = corpora.clean_reactions(df, mode="carry", strip_maps=False).collect()[0]
    assert carry["REAGENT"] == "[Na+].[Cl-]"
    stripped = corpora.clean_reactions(df).collect()[0]
    assert stripped["CATALYST"] == "[CH3]O"


def test_parse_products(spark):
    df = spark.createDataFrame([("PRODUCT:CO.PRODUCT:CC",), (None,)], "p string")
    out = [r[0] for r in df.select(rx.parse_products("p")).collect()]
    assert out == ["CO.CC", None]


def test_parse_condition(spark):
    cases = [("YIELD:50.0.TEMP:25.0", 50.0, 25.0), ("YIELD:7.0", 7.0, None), ("TEMP:3.0", None, 3.0),
             ("NONE", None, None), (None, None, None)]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], "c string")
    y, t = rx.parse_condition("c")
    got = df.select(y.alias("y"), t.alias("t")).collect()
    assert [(r.y, r.t) for r in got] == [(a, b) for _, a, b in cases]


def test_space_clean(spark):
    cases = {" . . ": " ", "A. . ": "A", " .B. ": "B", " . .C": "C"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = [r[0] for r in df.select(rx.space_clean("s")).collect()]
    assert got == list(cases.values())


def test_untag_and_clean_generated(spark):
    df = one(spark, "REACTANT:AREAGENT: PRODUCT:B")
    assert df.select(rx.untag_prompt("x")).collect()[0][0] == "A.B"
    assert one(spark, "C C O . . ").select(rx.clean_generated("x")).collect()[0][0] == "CCO"
    assert one(spark, "CCO").select(rx.char_spacing("x")).collect()[0][0] == "C C O"


def test_validity_and_canonical(spark):
    rows = [("CCO", True), ("C(", False), ("C1CC", False), ("c1ccccc1", True), ("[Na+].[Cl-]", True), ("", False)]
    df = spark.createDataFrame(rows, "s string, ok boolean")
    got = df.select("ok", sm.is_valid_smiles("s").alias("v")).collect()
    assert all(r.ok == r.v for r in got)
    c = one(spark, "[Na+].[CH3:1]O").select(sm.canonical_fragments("x")).collect()[0][0]
    assert c == "[CH3]O.[Na+]"
    assert one(spark, "C1CC.O").select(sm.canonical_fragments("x")).collect()[0][0] is None


def test_restore_roles(spark):
    df = spark.createDataFrame([(1, "R0", None, "P", "a.b.c"), (2, None, None, "P", None)],
                               "row_id long, REAGENT string, REACTANT string, PRODUCT string, NoData string")
    preds = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "smiles string, pred boolean")
    out = {r.row_id: r for r in restore_roles(df, preds, true_role="REACTANT").collect()}
    assert out[1]["REACTANT"] == "a.c" and out[1]["REAGENT"] == "R0.b"
    assert out[2]["REACTANT"] is None and out[2]["REAGENT"] is None


def test_first_per_key_keeps_earliest(spark):
    df = spark.createDataFrame([(3, "k", "late"), (1, "k", "early"), (2, "j", "x")], "row_id long, key string, v string")
    got = {r.key: (r.v, r.row_id) for r in corpora.first_per_key(df, ["key"]).collect()}
    assert got == {"k": ("early", 1), "j": ("x", 2)}
