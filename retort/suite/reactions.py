"""Checks for parsing, filters, corpora, compound functions, labels and restoration."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.functions import reaction as rx
from retort.functions import smiles as sm
from retort.operators import compounds as cp
from retort.operators import filters as fl
from retort.operators import labels as lb
from retort.plans import corpora
from retort.plans import restore as rs
from retort.sources import testdata as td
from retort.suite import register
from retort.suite import sqlbits as q

BASE = [td.SQL_RAW_REACTIONS, td.SQL_CLEAN]
W = td.with_sql
ROLE_LIST = "CATALYST, REACTANT, REAGENT, SOLVENT, INTERNAL_STANDARD, NoData"


def raw(spark, sf):
    return td.raw_reactions(spark, sf)


def clean(spark, sf):
    return corpora.clean_reactions(td.raw_reactions(spark, sf))


SQL_FWD_BASE = """
fx_fwd_base AS (
  SELECT row_id, coalesce(CATALYST, ' ') AS CATALYST, coalesce(REACTANT, ' ') AS REACTANT,
         coalesce(REAGENT, ' ') AS REAGENT, coalesce(SOLVENT, ' ') AS SOLVENT, coalesce(PRODUCT, ' ') AS PRODUCT
  FROM fx_clean WHERE PRODUCT IS NOT NULL)"""

SQL_FWD_FIRST = """
fx_fwd_first AS (
  SELECT REACTANT, CATALYST, REAGENT, SOLVENT, arg_min(PRODUCT, row_id) AS PRODUCT, min(row_id) AS row_id
  FROM fx_fwd_base WHERE REACTANT <> ' ' GROUP BY REACTANT, CATALYST, REAGENT, SOLVENT)"""

SQL_FWD = f"""
fx_fwd_merged AS (
  SELECT row_id, REACTANT, PRODUCT, CATALYST, SOLVENT,
         {q.space_clean("CATALYST || '.' || REAGENT || '.' || SOLVENT")} AS REAGENT FROM fx_fwd_first),
fx_fwd_canon AS (
  SELECT row_id, REACTANT, PRODUCT, CATALYST, SOLVENT, {q.canonical_or_blank('REAGENT')} AS REAGENT FROM fx_fwd_merged),
fx_fwd AS (
  SELECT row_id, REACTANT, PRODUCT, CATALYST, REAGENT, SOLVENT, 'REACTANT:' || REACTANT || 'REAGENT:' || REAGENT AS input
  FROM fx_fwd_canon WHERE length('REACTANT:' || REACTANT || 'REAGENT:' || REAGENT) <= 512)"""

FWD = BASE + [SQL_FWD_BASE, SQL_FWD_FIRST, SQL_FWD]

SQL_YIELD = f"""
fx_yield_in AS (
  SELECT YIELD / 100 AS YIELD, coalesce(CATALYST, ' ') AS CATALYST, coalesce(REACTANT, ' ') AS REACTANT,
         coalesce(REAGENT, ' ') AS REAGENT, coalesce(PRODUCT, ' ') AS PRODUCT
  FROM fx_clean WHERE YIELD IS NOT NULL AND NOT (YIELD > 100) AND REACTANT IS NOT NULL AND PRODUCT IS NOT NULL),
fx_yield_c AS (
  SELECT YIELD, {q.canonical_or_blank('REACTANT')} AS R,
         {q.canonical_or_blank(q.space_clean("CATALYST || '.' || REAGENT"))} AS G,
         {q.canonical_or_blank('PRODUCT')} AS P FROM fx_yield_in),
fx_yield AS (
  SELECT DISTINCT 'REACTANT:' || R || 'REAGENT:' || G || 'PRODUCT:' || P AS input, YIELD FROM fx_yield_c
  WHERE length('REACTANT:' || R || 'REAGENT:' || G || 'PRODUCT:' || P) <= 512)"""


# ------------------------------------------------------------------ parsing

@register("parse_roles", W(*BASE) + f" SELECT row_id, {ROLE_LIST} FROM fx_clean")
def _parse_roles(spark, sf):
    return clean(spark, sf).select("row_id", "CATALYST", "REACTANT", "REAGENT", "SOLVENT",
                                   "INTERNAL_STANDARD", "NoData")


_CARRY_ITEMS = """
fx_carry AS (
  SELECT row_id, list_reduce(string_split(input, '.'), lambda acc, x: {
      'last': coalesce(ROLE, acc.last),
      'out': list_append(acc.out, {'r': coalesce(ROLE, acc.last), 'v': CASE WHEN ROLE IS NULL THEN x ELSE substr(x, strpos(x, ':') + 1) END})},
      {'last': NULL::VARCHAR, 'out': []::STRUCT(r VARCHAR, v VARCHAR)[]}).out AS items
  FROM fx_raw_reactions)""".replace(
    "ROLE", "(CASE WHEN contains(x, 'CATALYST') THEN 'CATALYST' WHEN contains(x, 'REACTANT') THEN 'REACTANT' "
    "WHEN contains(x, 'REAGENT') THEN 'REAGENT' WHEN contains(x, 'SOLVENT') THEN 'SOLVENT' "
    "WHEN contains(x, 'INTERNAL_STANDARD') THEN 'INTERNAL_STANDARD' WHEN contains(x, 'NoData') THEN 'NoData' END)")


@register("parse_roles_carry", W(td.SQL_RAW_REACTIONS, _CARRY_ITEMS) + """
 SELECT row_id,
   nullif(array_to_string(list_transform(list_filter(items, lambda p: p.r = 'REAGENT'), lambda p: p.v), '.'), '') AS REAGENT,
   nullif(array_to_string(list_transform(list_filter(items, lambda p: p.r = 'CATALYST'), lambda p: p.v), '.'), '') AS CATALYST
 FROM fx_carry""")
def _parse_roles_carry(spark, sf):
    r = raw(spark, sf)
    it = rx.tagged_items("input", mode="carry")
    x = r.select("row_id", it.alias("items"))
    return x.select("row_id", rx.empty_as_null(rx.role_column(F.col("items"), "REAGENT")).alias("REAGENT"),
                    rx.empty_as_null(rx.role_column(F.col("items"), "CATALYST")).alias("CATALYST"))


@register("parse_products", W(*BASE) + " SELECT row_id, PRODUCT FROM fx_clean")
def _parse_products(spark, sf):
    return clean(spark, sf).select("row_id", "PRODUCT")


@register("parse_condition", W(*BASE) + " SELECT row_id, YIELD, TEMP FROM fx_clean")
def _parse_condition(spark, sf):
    return clean(spark, sf).select("row_id", "YIELD", "TEMP")


@register("strip_atom_maps", W(td.SQL_RAW_REACTIONS) + f" SELECT row_id, {q.strip_maps('input')} AS input FROM fx_raw_reactions")
def _strip_atom_maps(spark, sf):
    return raw(spark, sf).select("row_id", sm.strip_atom_maps("input").alias("input"))


@register("empty_as_null", W(*BASE[:1]) + """
 SELECT row_id, nullif(array_to_string(list_filter(string_split(replace(product, '.PRODUCT', 'PRODUCT'), 'PRODUCT:'),
        lambda x: x <> ''), '.'), '') AS PRODUCT FROM fx_raw_reactions""")
def _empty_as_null(spark, sf):
    return raw(spark, sf).select("row_id", rx.empty_as_null(rx.parse_products("product")).alias("PRODUCT"))


# ------------------------------------------------------------------ filters

@register("require_not_null", W(*BASE) + " SELECT row_id, PRODUCT, REACTANT FROM fx_clean WHERE PRODUCT IS NOT NULL")
def _require_not_null(spark, sf):
    return fl.require_not_null(clean(spark, sf), ["PRODUCT"]).select("row_id", "PRODUCT", "REACTANT")


@register("require_null", W(*BASE) + " SELECT row_id, NoData FROM fx_clean WHERE PRODUCT IS NOT NULL AND REACTANT IS NULL")
def _require_null(spark, sf):
    df = fl.require_null(fl.require_not_null(clean(spark, sf), ["PRODUCT"]), ["REACTANT"])
    return df.select("row_id", "NoData")


@register("rows_with_uncategorised", W(*BASE) + " SELECT row_id, NoData FROM fx_clean WHERE NoData IS NOT NULL")
def _rows_with_uncategorised(spark, sf):
    return fl.rows_with_uncategorised(clean(spark, sf)).select("row_id", "NoData")


@register("drop_over_100_yield", W(*BASE) + " SELECT row_id, YIELD FROM fx_clean WHERE YIELD IS NOT NULL AND NOT (YIELD > 100)")
def _drop_over_100(spark, sf):
    return fl.drop_over_100_yield(fl.require_not_null(clean(spark, sf), ["YIELD"])).select("row_id", "YIELD")


@register("fill_blank_roles", W(*BASE, SQL_FWD_BASE) + " SELECT * FROM fx_fwd_base")
def _fill_blank_roles(spark, sf):
    df = fl.require_not_null(clean(spark, sf), ["PRODUCT"])
    cols = ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT"]
    return fl.fill_blank_roles(df, cols).select("row_id", *cols)


@register("require_role_present", W(*BASE, SQL_FWD_BASE) + " SELECT row_id FROM fx_fwd_base WHERE REACTANT <> ' '")
def _require_role_present(spark, sf):
    df = fl.fill_blank_roles(fl.require_not_null(clean(spark, sf), ["PRODUCT"]), ["REACTANT"])
    return fl.require_role_present(df, "REACTANT").select("row_id")


@register("max_chars", W(td.SQL_RAW_REACTIONS) + " SELECT row_id, length(input) AS n FROM fx_raw_reactions WHERE length(input) <= 512")
def _max_chars(spark, sf):
    return fl.max_chars(raw(spark, sf), "input", 512).select("row_id", F.length("input").alias("n"))


@register("distinct_rows", W(*BASE, SQL_FWD_BASE) +
          " SELECT DISTINCT REACTANT, PRODUCT, CATALYST, REAGENT, SOLVENT FROM fx_fwd_base WHERE REACTANT <> ' '")
def _distinct_rows(spark, sf):
    df = fl.fill_blank_roles(fl.require_not_null(clean(spark, sf), ["PRODUCT"]),
                             ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT"])
    df = fl.require_role_present(df, "REACTANT")
    return df.select("REACTANT", "PRODUCT", "CATALYST", "REAGENT", "SOLVENT").distinct()


@register("first_per_key", W(*BASE, SQL_FWD_BASE, SQL_FWD_FIRST) + " SELECT * FROM fx_fwd_first")
def _first_per_key(spark, sf):
    df = fl.fill_blank_roles(fl.require_not_null(clean(spark, sf), ["PRODUCT"]),
                             ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT"])
    df = fl.require_role_present(df, "REACTANT").select(
        "row_id", "REACTANT", "PRODUCT", "CATALYST", "REAGENT", "SOLVENT")
    return corpora.first_per_key(df, ["REACTANT", "CATALYST", "REAGENT", "SOLVENT"])


# ------------------------------------------------------------------ corpora

@register("merge_reagents", W(*FWD) + " SELECT row_id, REAGENT FROM fx_fwd_merged")
def _merge_reagents(spark, sf):
    df = _first_per_key(spark, sf)
    return df.select("row_id", rx.merge_reagents("CATALYST", "REAGENT", "SOLVENT").alias("REAGENT"))


@register("canonicalise_compounds", W(*FWD) + " SELECT row_id, REAGENT FROM fx_fwd_canon")
def _canonicalise(spark, sf):
    from retort.plans.dictionary import dictionary_apply
    df = _merge_reagents(spark, sf)
    return dictionary_apply(df, "REAGENT", "REAGENT", sm.canonical_fragments, keep=lambda c: c != F.lit(" "))


@register("build_prompt", W(*FWD) + " SELECT row_id, 'REACTANT:' || REACTANT || 'REAGENT:' || REAGENT AS input FROM fx_fwd_canon")
def _build_prompt(spark, sf):
    df = _canonicalise(spark, sf).join(_first_per_key(spark, sf).select("row_id", "REACTANT"), "row_id")
    return df.select("row_id", rx.build_prompt(("REACTANT", "REACTANT"), ("REAGENT", "REAGENT")).alias("input"))


@register("forward_corpus", W(*FWD) + " SELECT * FROM fx_fwd")
def _forward_corpus(spark, sf):
    return corpora.forward_corpus(clean(spark, sf))


@register("retro_corpus", W(*BASE, SQL_FWD_BASE, SQL_FWD_FIRST, SQL_FWD) + """
 SELECT row_id, REACTANT, PRODUCT, CATALYST, REAGENT, SOLVENT, 'PRODUCT:' || PRODUCT || 'REAGENT:' || REAGENT AS input
 FROM fx_fwd_canon WHERE length('PRODUCT:' || PRODUCT || 'REAGENT:' || REAGENT) <= 512""")
def _retro_corpus(spark, sf):
    return corpora.retro_corpus(clean(spark, sf))


@register("yield_corpus", W(*BASE, SQL_YIELD) + " SELECT * FROM fx_yield")
def _yield_corpus(spark, sf):
    return corpora.yield_corpus(clean(spark, sf))


# ------------------------------------------------------------------ string functions

@register("space_clean", W(*BASE) + f"""
 SELECT row_id, {q.space_clean("coalesce(CATALYST, ' ') || '.' || coalesce(REAGENT, ' ') || '.' || coalesce(SOLVENT, ' ')")} AS merged
 FROM fx_clean""")
def _space_clean(spark, sf):
    c = clean(spark, sf)
    return c.select("row_id", rx.space_clean(F.concat(rx.fill_blank("CATALYST"), F.lit("."), rx.fill_blank("REAGENT"),
                                                      F.lit("."), rx.fill_blank("SOLVENT"))).alias("merged"))


@register("build_flat_input", W(*BASE) + """
 SELECT row_id, regexp_replace(coalesce(REACTANT, ' ') || '.' || coalesce(REAGENT, ' ') || '.' || coalesce(PRODUCT, ' '), '. ', '', 'g') AS flat
 FROM fx_clean""")
def _build_flat_input(spark, sf):
    c = clean(spark, sf)
    return c.select("row_id", rx.build_flat_input(rx.fill_blank("REACTANT"), rx.fill_blank("REAGENT"),
                                                  rx.fill_blank("PRODUCT")).alias("flat"))


@register("untag_prompt", W(*BASE, SQL_YIELD) + """
 SELECT regexp_replace(replace(replace(replace(input, 'REACTANT:', ''), 'REAGENT:', '.'), 'PRODUCT:', '.'), '. ', '', 'g') AS flat, YIELD
 FROM fx_yield""")
def _untag_prompt(spark, sf):
    y = corpora.yield_corpus(clean(spark, sf))
    return y.select(rx.untag_prompt("input").alias("flat"), "YIELD")


@register("clean_generated", W(td.SQL_BEAMS) + " SELECT id, rank, rtrim(replace(seq, ' ', ''), '.') AS pred FROM fx_beams")
def _clean_generated(spark, sf):
    b = td.beams_fx(spark, sf)
    return b.select("id", "rank", rx.clean_generated("seq").alias("pred"))


@register("char_spacing", W(*BASE) + " SELECT row_id, array_to_string(string_split(PRODUCT, ''), ' ') AS spaced FROM fx_clean")
def _char_spacing(spark, sf):
    return clean(spark, sf).select("row_id", rx.char_spacing("PRODUCT").alias("spaced"))


@register("generation_bounds", W(*FWD) + """
 SELECT row_id, greatest(strpos(input, 'REAGENT') - strpos(input, ':') - 20, 0) AS min_len,
        strpos(input, 'REAGENT') - strpos(input, ':') + 20 AS max_len FROM fx_fwd""")
def _generation_bounds(spark, sf):
    f = corpora.forward_corpus(clean(spark, sf))
    lo, hi = rx.generation_bounds("input")
    return f.select("row_id", lo.alias("min_len"), hi.alias("max_len"))


@register("stringify", W(*BASE) + " SELECT row_id, CAST(TEMP AS VARCHAR) AS TEMP FROM fx_clean")
def _stringify(spark, sf):
    return clean(spark, sf).select("row_id", rx.stringify("TEMP").alias("TEMP"))


@register("clip", W(*BASE) + " SELECT row_id, CASE WHEN YIELD IS NOT NULL THEN greatest(least(YIELD, 100.0), 0.0) END AS YIELD FROM fx_clean")
def _clip(spark, sf):
    return clean(spark, sf).select("row_id", rx.clip("YIELD").alias("YIELD"))


SQL_COMPOUNDS = f"""
fx_compounds AS (
  SELECT DISTINCT c AS smiles FROM (
    SELECT unnest(string_split(v, '.')) AS c FROM (
      SELECT unnest([{ROLE_LIST}, PRODUCT]) AS v FROM fx_clean) WHERE v IS NOT NULL))"""


# Rare elements, a compound of unknown atoms, two-digit ring closures and charges beside the pool's compounds.
MORE_COMPOUNDS = ["[Ru]Cl", "[As]C", "[H][H]", "[Xx]C", "C%10CC", "C%10CC%10", "C%11CC%12", "[O-][N+](=O)c1ccccc1", "F/C=C/F",
                  "N[C@@H](C)C(=O)O", "[nH]1cccc1", "C12CC1C2"]
SQL_MORE = ("fx_more AS (SELECT smiles FROM fx_compounds UNION SELECT unnest(["
            + ", ".join(f"'{c}'" for c in MORE_COMPOUNDS) + "]))")


def more_compounds(spark, sf):
    more = spark.createDataFrame([(c,) for c in MORE_COMPOUNDS], "smiles string")
    return cp.distinct_compounds(clean(spark, sf)).unionByName(more).distinct()


def _is_valid_sql():
    return W(*BASE, SQL_COMPOUNDS, SQL_MORE) + f" SELECT smiles, {q.is_valid('smiles')} AS valid FROM fx_more"


@register("is_valid_smiles", _is_valid_sql())
def _is_valid(spark, sf):
    return more_compounds(spark, sf).select("smiles", sm.is_valid_smiles("smiles").alias("valid"))


@register("fragment_shuffle", W(*BASE) + f"""
 SELECT row_id, CASE WHEN {q.is_valid('REAGENT')} THEN array_to_string(list_transform(list_sort(
     list_transform(string_split(REAGENT, '.'), lambda f, i: {{'k': md5('42|' || REAGENT || '|' || CAST(i - 1 AS VARCHAR)), 'f': f}})),
     lambda s: s.f), '.') END AS shuffled
 FROM fx_clean WHERE REAGENT IS NOT NULL""")
def _fragment_shuffle(spark, sf):
    c = clean(spark, sf).where(F.col("REAGENT").isNotNull())
    return c.select("row_id", sm.fragment_shuffle("REAGENT", seed=42).alias("shuffled"))


def _weights_sql():
    from retort.operators.compounds import ATOMIC_WEIGHTS
    vals = ", ".join(f"('{s}', {w})" for s, w in ATOMIC_WEIGHTS)
    return f"fx_weights AS (SELECT symbol, CAST(weight AS DOUBLE) AS weight FROM (VALUES {vals}) t(symbol, weight))"


@register("heavy_atom_weight", W(*BASE, SQL_COMPOUNDS, SQL_MORE, _weights_sql()) + r"""
 , a AS (SELECT smiles, list_concat(regexp_extract_all(smiles, '\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?)', 1),
          regexp_extract_all(regexp_replace(smiles, '\[[^\[\]]*\]', '', 'g'), '(Br|Cl|[BCNOPSFI]|[bcnops])', 1)) AS atoms FROM fx_more)
 , s AS (SELECT smiles, unnest(list_transform(atoms, lambda x: upper(substr(x, 1, 1)) || substr(x, 2))) AS symbol FROM a)
 , w AS (SELECT smiles, round(sum(CASE WHEN symbol = 'H' THEN 0.0 ELSE weight END), 4) AS total,
                count(*) FILTER (WHERE weight IS NULL) AS unknown FROM s LEFT JOIN fx_weights USING (symbol) GROUP BY smiles)
 SELECT a.smiles, CASE WHEN len(a.atoms) = 0 THEN 0.0 WHEN unknown = 0 THEN total END AS heavy_weight FROM a LEFT JOIN w USING (smiles)""")
def _heavy_atom_weight(spark, sf):
    return cp.heavy_atom_weight(more_compounds(spark, sf), "smiles")


# ------------------------------------------------------------------ labels

SQL_LABELS = f"""
fx_exploded AS (
  SELECT smiles, target, min(ord) AS ord FROM (
    SELECT unnest(string_split(v, '.')) AS smiles, code AS target, code * 1000000000000 + row_id AS ord FROM (
      SELECT row_id, unnest([{ROLE_LIST}]) AS v, unnest([0, 1, 2, 3, 4, 5]) AS code FROM fx_clean) WHERE v IS NOT NULL)
  GROUP BY smiles, target)"""


@register("explode_compounds", W(*BASE, SQL_LABELS) + " SELECT smiles, target FROM fx_exploded")
def _explode_compounds(spark, sf):
    return lb.explode_compounds(clean(spark, sf)).select("smiles", "target")


@register("label_filter", W(*BASE, SQL_LABELS) + " SELECT smiles, target FROM fx_exploded WHERE target NOT IN (4, 5)")
def _label_filter(spark, sf):
    return lb.label_filter(lb.explode_compounds(clean(spark, sf)), exclude=[4, 5]).select("smiles", "target")


@register("binarise_label", W(*BASE, SQL_LABELS) + """
 SELECT DISTINCT smiles, CASE WHEN target = 1 THEN 1 ELSE 0 END AS target
 FROM fx_exploded WHERE target NOT IN (4, 5)""")
def _binarise(spark, sf):
    return lb.binary_labels(clean(spark, sf))


@register("invert_label", W(*BASE, SQL_LABELS) + """
 SELECT DISTINCT smiles, 1 - CASE WHEN target = 1 THEN 1 ELSE 0 END AS target FROM fx_exploded WHERE target NOT IN (4, 5)""")
def _invert(spark, sf):
    return lb.invert_label(lb.binary_labels(clean(spark, sf)), "target").select("smiles", "target")


@register("value_counts", W(*BASE, SQL_LABELS) + " SELECT target, count(*) AS n FROM fx_exploded GROUP BY target")
def _value_counts(spark, sf):
    from retort.operators.aggregates import value_counts
    return value_counts(lb.explode_compounds(clean(spark, sf)), "target")


# ------------------------------------------------------------------ restoration

SQL_RESTORE = """
fx_restore_in AS (
  SELECT row_id, REAGENT, REACTANT, PRODUCT, YIELD, TEMP, NoData FROM fx_clean
  WHERE PRODUCT IS NOT NULL AND REACTANT IS NULL),
fx_nd AS (
  SELECT row_id, unnest(string_split(NoData, '.')) AS smiles, generate_subscripts(string_split(NoData, '.'), 1) AS pos
  FROM fx_restore_in WHERE NoData IS NOT NULL),
fx_known AS (SELECT * FROM fx_role_predictions WHERE smiles <> 'CC#N'),
fx_nd_pred AS (SELECT n.row_id, n.pos, n.smiles, p.pred FROM fx_nd n LEFT JOIN fx_known p USING (smiles)),
fx_routed AS (
  SELECT row_id,
         string_agg(CASE WHEN pred THEN smiles END, '.' ORDER BY pos) AS to_true,
         string_agg(CASE WHEN NOT pred THEN smiles END, '.' ORDER BY pos) AS to_false,
         string_agg(CASE WHEN pred IS NULL THEN smiles END, '.' ORDER BY pos) AS unrouted
  FROM fx_nd_pred GROUP BY row_id),
fx_restored AS (
  SELECT i.row_id,
         nullif(concat_ws('.', i.REAGENT, r.to_false), '') AS REAGENT,
         nullif(concat_ws('.', i.REACTANT, r.to_true), '') AS REACTANT,
         i.PRODUCT, i.YIELD, i.TEMP, r.unrouted AS NoData
  FROM fx_restore_in i LEFT JOIN fx_routed r USING (row_id))"""


@register("lookup_join", W(*BASE, td.SQL_ROLE_PREDICTIONS, SQL_RESTORE) + " SELECT row_id, pos - 1 AS pos, smiles, pred FROM fx_nd_pred")
def _lookup_join(spark, sf):
    c = clean(spark, sf)
    preds = td.role_predictions(c).where("smiles <> 'CC#N'")  # a gap
    sub = fl.require_null(fl.require_not_null(c, ["PRODUCT"]), ["REACTANT"])
    nd = sub.select("row_id", F.posexplode(F.split("NoData", r"\.")).alias("pos", "smiles"))
    from retort.operators.joins import lookup_join
    return lookup_join(nd, preds, "smiles", on_missing="keep").select("row_id", "pos", "smiles", "pred")


@register("lookup_join_error", W(*BASE, td.SQL_ROLE_PREDICTIONS) + """
 , u AS (SELECT row_id, unnest(string_split(NoData, '.')) AS smiles FROM fx_clean WHERE NoData IS NOT NULL)
 SELECT row_id, smiles, pred FROM u JOIN fx_role_predictions USING (smiles) WHERE smiles <> ''""")
def _lookup_join_error(spark, sf):
    """A dictionary that holds every key; a gap would make the job fail."""
    from retort.operators.joins import lookup_join
    c = clean(spark, sf)
    nd = c.select("row_id", F.explode(F.split("NoData", r"\.")).alias("smiles")).where("smiles <> ''")
    return lookup_join(nd, td.role_predictions(c), "smiles", on_missing="error").select("row_id", "smiles", "pred")


@register("restore_roles", W(*BASE, td.SQL_ROLE_PREDICTIONS, SQL_RESTORE) + " SELECT * FROM fx_restored")
def _restore_roles(spark, sf):
    c = clean(spark, sf)
    preds = td.role_predictions(c).where("smiles <> 'CC#N'")  # a gap
    sub = fl.require_null(fl.require_not_null(c, ["PRODUCT"]), ["REACTANT"])
    return rs.restore_roles(sub, preds, true_role="REACTANT", on_missing="keep").select(
        "row_id", "REAGENT", "REACTANT", "PRODUCT", "YIELD", "TEMP", "NoData")


@register("union_by_name", W(*BASE, td.SQL_ROLE_PREDICTIONS, SQL_RESTORE) + f"""
 , fx_u AS (
   SELECT row_id, CATALYST, REACTANT, REAGENT, SOLVENT, PRODUCT FROM fx_clean WHERE PRODUCT IS NOT NULL
   UNION ALL
   SELECT row_id + 1000000000000 AS row_id, NULL, REACTANT, REAGENT, NULL, PRODUCT FROM fx_restored),
 fx_ub AS (SELECT row_id, coalesce(CATALYST, ' ') AS CATALYST, coalesce(REACTANT, ' ') AS REACTANT,
         coalesce(REAGENT, ' ') AS REAGENT, coalesce(SOLVENT, ' ') AS SOLVENT, coalesce(PRODUCT, ' ') AS PRODUCT FROM fx_u),
 fx_uf AS (SELECT REACTANT, CATALYST, REAGENT, SOLVENT, arg_min(PRODUCT, row_id) AS PRODUCT, min(row_id) AS row_id
   FROM fx_ub WHERE REACTANT <> ' ' GROUP BY ALL),
 fx_um AS (SELECT row_id, REACTANT, PRODUCT, CATALYST, SOLVENT,
   {q.canonical_or_blank(q.space_clean("CATALYST || '.' || REAGENT || '.' || SOLVENT"))} AS REAGENT FROM fx_uf)
 SELECT row_id, REACTANT, PRODUCT, CATALYST, REAGENT, SOLVENT, 'REACTANT:' || REACTANT || 'REAGENT:' || REAGENT AS input
 FROM fx_um WHERE length('REACTANT:' || REACTANT || 'REAGENT:' || REAGENT) <= 512""")
def _union_by_name(spark, sf):
    c = clean(spark, sf)
    preds = td.role_predictions(c).where("smiles <> 'CC#N'")  # a gap
    sub = fl.require_null(fl.require_not_null(c, ["PRODUCT"]), ["REACTANT"])
    restored = rs.restore_roles(sub, preds, true_role="REACTANT", on_missing="keep").select(
        (F.col("row_id") + F.lit(1000000000000)).alias("row_id"), "REAGENT", "REACTANT", "PRODUCT", "YIELD", "TEMP", "NoData")
    return corpora.forward_corpus(c, restored=restored)


# ------------------------------------------------------------------ projections, dictionary plan, further corpora

@register("select_columns", W(*BASE) + " SELECT row_id, REACTANT, PRODUCT FROM fx_clean")
def _select_columns(spark, sf):
    return fl.select_columns(clean(spark, sf), ["row_id", "REACTANT", "PRODUCT"])


@register("drop_columns", W(*BASE) + " SELECT row_id, CATALYST, REACTANT, REAGENT, SOLVENT, INTERNAL_STANDARD, NoData, PRODUCT FROM fx_clean")
def _drop_columns(spark, sf):
    return fl.drop_columns(clean(spark, sf), ["YIELD", "TEMP"])


@register("dictionary_apply", W(*BASE) + """
 SELECT row_id, CASE WHEN REACTANT = ' ' THEN REACTANT ELSE reverse(REACTANT) END AS REACTANT, reverse(PRODUCT) AS PRODUCT FROM fx_clean""")
def _dictionary_apply(spark, sf):
    from retort.plans.dictionary import compound_function, dictionary_apply_all
    turned = compound_function("reverse", lambda s: s.str[::-1])
    c = clean(spark, sf).select("row_id", "REACTANT", "PRODUCT")
    return dictionary_apply_all(c, ["REACTANT", "PRODUCT"], turned, keep=lambda x: x != F.lit(" "))


@register("canonical_clean", W(*BASE) + f"""
 SELECT row_id, {', '.join(f'{q.canonical(c)} AS {c}' for c in ['CATALYST', 'REACTANT', 'REAGENT', 'SOLVENT', 'INTERNAL_STANDARD',
                                                             'NoData', 'PRODUCT'])} FROM fx_clean""")
def _canonical_clean(spark, sf):
    return corpora.clean_reactions(raw(spark, sf), canonicalise="default").drop("YIELD", "TEMP")


@register("four_role_corpus", W(*BASE) + """
 , b AS (SELECT row_id, coalesce(REACTANT, ' ') AS REACTANT, coalesce(CATALYST, ' ') AS CATALYST, coalesce(REAGENT, ' ') AS REAGENT,
                coalesce(SOLVENT, ' ') AS SOLVENT, PRODUCT FROM fx_clean WHERE PRODUCT IS NOT NULL)
 , g AS (SELECT REACTANT, CATALYST, REAGENT, SOLVENT, min(row_id) AS row_id, arg_min(PRODUCT, row_id) AS PRODUCT FROM b
         WHERE REACTANT <> ' ' GROUP BY ALL)
 , p AS (SELECT *, 'REACTANT:' || REACTANT || 'CATALYST:' || CATALYST || 'REAGENT:' || REAGENT || 'SOLVENT:' || SOLVENT AS input FROM g)
 SELECT row_id, REACTANT, CATALYST, REAGENT, SOLVENT, PRODUCT, input FROM p WHERE length(input) <= 512""")
def _four_role(spark, sf):
    return corpora.four_role_corpus(clean(spark, sf))


@register("finetune_yield", W(*BASE) + """
 SELECT row_id, 'REACTANT:' || coalesce(REACTANT, ' ') || 'REAGENT:' || coalesce(REAGENT, ' ') || 'PRODUCT:' || coalesce(PRODUCT, ' ') AS input,
        least(greatest(YIELD, 0.0), 100.0) / 100 AS YIELD FROM fx_clean WHERE YIELD IS NOT NULL""")
def _finetune_yield(spark, sf):
    return corpora.finetune_yield_corpus(clean(spark, sf))


@register("finetune_forward", W(*BASE) + f"""
 SELECT row_id, 'REACTANT:' || REACTANT || 'REAGENT:' || coalesce(REAGENT, ' ') AS input, PRODUCT FROM fx_clean
 WHERE PRODUCT IS NOT NULL AND REACTANT IS NOT NULL ORDER BY {q.hkey(42, 'row_id')}, row_id LIMIT 200""")
def _finetune_forward(spark, sf):
    return corpora.finetune_forward_corpus(clean(spark, sf), n=200, seed=42)


@register("first_per_key_shuffled", W(*BASE, td.SQL_ROLE_PREDICTIONS, SQL_RESTORE) + f"""
 , u AS (SELECT row_id, CATALYST, REACTANT, REAGENT, SOLVENT, PRODUCT FROM fx_clean WHERE PRODUCT IS NOT NULL
         UNION ALL SELECT row_id + 1000000000000, NULL, REACTANT, REAGENT, NULL, PRODUCT FROM fx_restored)
 , b AS (SELECT row_id, coalesce(CATALYST, ' ') AS CATALYST, coalesce(REACTANT, ' ') AS REACTANT, coalesce(REAGENT, ' ') AS REAGENT,
                coalesce(SOLVENT, ' ') AS SOLVENT, coalesce(PRODUCT, ' ') AS PRODUCT FROM u)
 SELECT REACTANT, CATALYST, REAGENT, SOLVENT, arg_min(PRODUCT, {q.hkey(42, 'row_id')}) AS PRODUCT,
        arg_min(row_id, {q.hkey(42, 'row_id')}) AS row_id FROM b WHERE REACTANT <> ' ' GROUP BY ALL""")
def _first_per_key_shuffled(spark, sf):
    """Restored rows take part in a seeded order, so the original row does not always win."""
    c = clean(spark, sf)
    preds = td.role_predictions(c).where("smiles <> 'CC#N'")
    sub = fl.require_null(fl.require_not_null(c, ["PRODUCT"]), ["REACTANT"])
    restored = rs.restore_roles(sub, preds, true_role="REACTANT", on_missing="keep").withColumn(
        "row_id", F.col("row_id") + F.lit(1000000000000))
    both = c.where("PRODUCT IS NOT NULL").unionByName(restored.withColumns(
        {n: F.lit(None).cast("string") for n in ("CATALYST", "SOLVENT")}), allowMissingColumns=True)
    cols = ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT"]
    df = fl.fill_blank_roles(both.select("row_id", *cols), cols).where("REACTANT <> ' '")
    return corpora.first_per_key(df, ["REACTANT", "CATALYST", "REAGENT", "SOLVENT"], shuffle_seed=42)
