"""Reaction-shaped fixtures derived from the driver's TPC-H-like tables.

Each fixture exists twice: as a Spark DataFrame builder and as a SQL
common-table expression with the same meaning (used by the oracle checks).
The derivations follow FIXTURES.md §3.  The compound pool is a fixed list;
``C1CC`` is deliberately invalid (open ring) and two entries carry an atom
map and an unlabelled second fragment.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.hashing import md5_u32

# Compound pool, indexed by key mod 16.
POOL = ["C1CCOC1", "ClCCl", "O", "CC#N", "CCO", "CO", "c1ccccc1", "[CH3:1]O",
        "CC(=O)O", "[Na+].[Cl-]", "CCN(CC)CC", "O=C1CCCN1", "Brc1ccccc1", "[Pd]",
        "C1CC", "N"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pool_at(idx):
    return F.element_at(F.array(*[F.lit(p) for p in POOL]), (idx % 16 + 1).cast("int"))


def _line_role():
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    return (F.when((rf == "A") & (ls == "F"), "CATALYST")
            .when((rf == "A") & (ls == "O"), "REACTANT")
            .when((rf == "R") & (ls == "O"), "REAGENT")
            .when((rf == "R") & (ls == "F"), "SOLVENT")
            .when((rf == "N") & (ls == "O"),
                  F.when(F.col("l_linenumber") % 2 == 0, "INTERNAL_STANDARD").otherwise("REACTANT"))
            .when((rf == "N") & (ls == "F"), "NoData"))


def raw_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_raw_reactions(id, input, product, condition, row_id): one row per order.

    Tokens of an order are sorted as text and '.'-joined.  An order has a
    handful of lines, so the per-order token list is small; the aggregate
    leaves its output hash-partitioned on the order key, which the left
    join with ``orders`` reuses (only ``orders`` is shuffled).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    tokens = (li.select("l_orderkey",
                        F.concat(_line_role(), F.lit(":"), _pool_at(F.col("l_partkey"))).alias("tok"))
              .groupBy("l_orderkey")
              .agg(F.array_join(F.array_sort(F.collect_list("tok")), ".").alias("input")))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    y = F.concat(F.lit("YIELD:"), (ok % 120).cast("string"), F.lit(".0"))
    t = F.concat(F.lit("TEMP:"), (ck % 90).cast("string"), F.lit(".0"))
    prio = F.substring("o_orderpriority", 1, 1)
    cond = (F.when(prio == "1", F.concat(y, F.lit("."), t))
            .when(prio == "2", y).when(prio == "3", t).when(prio == "5", F.lit("NONE")))
    product = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("PRODUCT:"), _pool_at(ck)))
    return (o.join(tokens, o.o_orderkey == tokens.l_orderkey, "left")
            .select(ok.cast("string").alias("id"), "input", product.alias("product"),
                    cond.alias("condition"), ok.alias("row_id")))


def role_predictions(clean: DataFrame) -> DataFrame:
    """fx_role_predictions(smiles, pred): distinct NoData compounds, pred = md5 hex[0] < '8'."""
    comp = (clean.select(F.explode(F.split("NoData", r"\.")).alias("smiles"))
            .where(F.col("smiles") != "").distinct())
    return comp.select("smiles", (F.substring(F.md5("smiles"), 1, 1) < F.lit("8")).alias("pred"))


def labels_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_labels(doc_id, target): quality labels, row order = doc_id."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target"))


def scores_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_scores(id, target, score): score = first 8 md5 hex digits of the id / 2^32."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("target"),
                      (md5_u32(F.col("doc_id").cast("string")) / F.lit(4294967296.0)).alias("score"))


def regression_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_regression(id, y, p): y = value clipped to 0..100, p = y + (id mod 41) - 20, clipped."""
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    y = F.greatest(F.least(F.col("value"), F.lit(100.0)), F.lit(0.0))
    p = F.greatest(F.least(y + (F.col("event_id") % 41).cast("double") - 20.0, F.lit(100.0)), F.lit(0.0))
    return ev.select(F.col("event_id").alias("id"), y.alias("y"), p.alias("p"))


def beams_fx(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """fx_beams(id, rank, seq, score, target): k hashed pool entries per order.

    seq = pool[md5(order|rank) mod 16] with a decoder-style spacing so that
    ``clean_generated`` has work to do; score falls with rank; target is
    the order's product compound.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    r = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank")
    x = o.select("o_orderkey", "o_custkey", r)
    h = md5_u32(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("rank").cast("string")))
    seq = F.concat(F.array_join(F.split(_pool_at(h), ""), " "), F.lit(" ."))
    score = -(F.col("rank").cast("double") + 1.0) - (F.col("o_orderkey") % 7).cast("double") / 8.0
    return x.select(F.col("o_orderkey").alias("id"), "rank", seq.alias("seq"), score.alias("score"),
                    _pool_at(F.col("o_custkey")).alias("target"))


def epochs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_epochs(run, epoch, loss, n): per user, epoch = 1-based order by (ts, event_id).

    The per-user window is the natural key of this log; users hold a
    bounded number of events in the test data.
    """
    from retort.plans.rowindex import global_index
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    # bucketed per-user positions: a user holding a third of all events spreads over many tasks
    x = global_index(ev, ["ts", "event_id"], by=["user_id"], total_col=None)
    return x.select(F.col("user_id").alias("run"), (F.col("idx") + 1).cast("int").alias("epoch"),
                    F.col("value").alias("loss"), (F.col("event_id") % 5 + 1).alias("n"))


# ---------------------------------------------------------------- SQL twins

def _sql_pool(idx: str) -> str:
    items = ", ".join("'" + p + "'" for p in POOL)
    return f"([{items}])[({idx}) % 16 + 1]"


SQL_RAW_REACTIONS = f"""
fx_raw_reactions AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS id, t.input,
         CASE WHEN o.o_orderstatus <> 'P' THEN 'PRODUCT:' || {_sql_pool('o.o_custkey')} END AS product,
         CASE substr(o.o_orderpriority, 1, 1)
              WHEN '1' THEN 'YIELD:' || (o.o_orderkey % 120) || '.0.TEMP:' || (o.o_custkey % 90) || '.0'
              WHEN '2' THEN 'YIELD:' || (o.o_orderkey % 120) || '.0'
              WHEN '3' THEN 'TEMP:' || (o.o_custkey % 90) || '.0'
              WHEN '5' THEN 'NONE' END AS condition,
         o.o_orderkey AS row_id
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, string_agg(tok, '.' ORDER BY tok) AS input
    FROM (SELECT l_orderkey,
                 CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CATALYST'
                      WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'REACTANT'
                      WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'REAGENT'
                      WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'SOLVENT'
                      WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN
                           CASE WHEN l_linenumber % 2 = 0 THEN 'INTERNAL_STANDARD' ELSE 'REACTANT' END
                      WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'NoData' END
                 || ':' || {_sql_pool('l_partkey')} AS tok
          FROM lineitem) GROUP BY l_orderkey) t ON t.l_orderkey = o.o_orderkey)"""

_ROLE_CASE = ("CASE WHEN contains(x, 'CATALYST') THEN 'CATALYST' WHEN contains(x, 'REACTANT') THEN 'REACTANT' "
              "WHEN contains(x, 'REAGENT') THEN 'REAGENT' WHEN contains(x, 'SOLVENT') THEN 'SOLVENT' "
              "WHEN contains(x, 'INTERNAL_STANDARD') THEN 'INTERNAL_STANDARD' WHEN contains(x, 'NoData') THEN 'NoData' END")

_MAPS = r"regexp_replace({x}, '(\[[^\[\]:]*):[0-9]+\]', '\1]', 'g')"


def _sql_role(role: str) -> str:
    inner = f"array_to_string(list_transform(list_filter(items, lambda p: p.r = '{role}'), lambda p: p.v), '.')"
    return f"{_MAPS.format(x=f'nullif({inner}, {chr(39)}{chr(39)})')} AS {role}"


def _num(s: str) -> str:
    return f"TRY_CAST(substr({s}, strpos({s}, ':') + 1) AS DOUBLE)"


SQL_CLEAN = f"""
fx_items AS (
  SELECT row_id, product, condition,
         list_transform(string_split(input, '.'), lambda x: {{'r': {_ROLE_CASE}, 'v': substr(x, strpos(x, ':') + 1)}}) AS items
  FROM fx_raw_reactions),
fx_clean AS (
  SELECT row_id,
         {_sql_role('CATALYST')}, {_sql_role('REACTANT')}, {_sql_role('REAGENT')},
         {_sql_role('SOLVENT')}, {_sql_role('INTERNAL_STANDARD')}, {_sql_role('NoData')},
         {_MAPS.format(x="nullif(array_to_string(list_filter(string_split(replace(product, '.PRODUCT', 'PRODUCT'), 'PRODUCT:'), lambda x: x <> ''), '.'), '')")} AS PRODUCT,
         CASE WHEN contains(condition, 'YIELD') AND contains(condition, 'TEMP')
                   THEN {_num("substr(condition, 1, strpos(condition, '.T') - 1)")}
              WHEN contains(condition, 'YIELD') THEN {_num('condition')} END AS YIELD,
         CASE WHEN contains(condition, 'YIELD') AND contains(condition, 'TEMP')
                   THEN {_num("substr(condition, strpos(condition, '.T'))")}
              WHEN contains(condition, 'TEMP') THEN {_num('condition')} END AS TEMP
  FROM fx_items)"""

SQL_ROLE_PREDICTIONS = """
fx_role_predictions AS (
  SELECT smiles, substr(md5(smiles), 1, 1) < '8' AS pred
  FROM (SELECT DISTINCT unnest(string_split(NoData, '.')) AS smiles FROM fx_clean) WHERE smiles <> '')"""

SQL_SCORES = """
fx_scores AS (
  SELECT doc_id AS id, quality AS target,
         CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS score
  FROM labels)"""

SQL_REGRESSION = """
fx_regression AS (
  SELECT id, y, greatest(least(y + CAST(id % 41 AS DOUBLE) - 20.0, 100.0), 0.0) AS p
  FROM (SELECT event_id AS id, greatest(least(value, 100.0), 0.0) AS y FROM events))"""

SQL_BEAMS = f"""
fx_beams AS (
  SELECT o_orderkey AS id, rank,
         array_to_string(string_split({_sql_pool("CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(rank AS VARCHAR)), 1, 8)) AS BIGINT)")}, ''), ' ') || ' .' AS seq,
         -(CAST(rank AS DOUBLE) + 1.0) - CAST(o_orderkey % 7 AS DOUBLE) / 8.0 AS score,
         {_sql_pool('o_custkey')} AS target
  FROM orders, (SELECT range AS rank FROM range(5)))"""

SQL_EPOCHS = """
fx_epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         value AS loss, event_id % 5 + 1 AS n
  FROM events)"""


def with_sql(*ctes: str) -> str:
    """'WITH a AS (...), b AS (...)' from CTE fragments."""
    return "WITH " + ",".join(c.strip("\n") for c in ctes)
