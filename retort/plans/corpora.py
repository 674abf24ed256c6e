"""End-to-end corpus jobs: raw reactions -> clean table -> task corpora.

Each job is one lazy plan.  Order-dependent steps (first product per key)
use the source ``row_id`` rather than a position that a shuffle could
change.  Shuffles: one aggregation per dedup step and the split index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions import reaction as rx
from retort.functions.hashing import hash_key
from retort.functions import smiles as sm
from retort.plans.dictionary import dictionary_apply, dictionary_apply_all
from retort.schema import BLANK, ROLES


def once(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with further columns, each computed once a row.

    They come out of a generator, which a condition on them does not pass.
    Out of a projection every condition would take a copy of their
    expressions with it, down to the scan or below an aggregate.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def clean_reactions(raw: DataFrame, mode: str = "strict", strip_maps: bool = True,
                    keep=("row_id",), canonicalise=None) -> DataFrame:
    """Raw (id, input, product, condition) -> six roles, PRODUCT, YIELD, TEMP.

    Empty role lists come out null (what a CSV round trip makes of them).
    ``strip_maps`` removes atom-map numbers from every compound;
    ``canonicalise`` ("default", a column function or a registered batch
    function) then normalises all seven columns, with one pass over their
    distinct values; what it cannot read becomes null.
    """
    items = once(raw.select(*[c for c in keep if c in raw.columns], "product", "condition", "input"),
                 {"__items": rx.tagged_items("input", mode)})
    y, t = rx.parse_condition(F.col("condition"))
    norm = sm.strip_atom_maps if strip_maps else (lambda c: c)
    cols = [norm(rx.empty_as_null(rx.role_column(F.col("__items"), r))).alias(r) for r in ROLES]
    cols.append(norm(rx.empty_as_null(rx.parse_products("product"))).alias("PRODUCT"))
    out = items.select(*[c for c in keep if c in raw.columns], *cols, y.alias("YIELD"), t.alias("TEMP"))
    if canonicalise is None:
        return out
    fn = sm.canonical_fragments if canonicalise == "default" else canonicalise
    return dictionary_apply_all(out, [*ROLES, "PRODUCT"], fn)


def first_per_key(df: DataFrame, keys: list, order: str = "row_id", shuffle_seed: int | None = None) -> DataFrame:
    """Keep, per key, the row that comes first in ``order`` (or in the seeded shuffle of ``order``).

    Written as an aggregate (``min_by`` over a struct) rather than a
    window: partial aggregation reduces a hot key map-side, so a key that
    holds a third of the rows never lands whole in one task.  What follows is
    computed for the kept rows only: a condition on the keys (such as the
    length of a canonical prompt) is not taken below the aggregate.
    """
    others = [c for c in df.columns if c not in keys and c != order]
    packed = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in others])
    rank = F.col(order) if shuffle_seed is None else F.struct(hash_key(shuffle_seed, order), F.col(order))
    agg = df.groupBy(*keys).agg(F.min_by(packed, rank).alias("__r"))
    agg = once(agg, {k: F.col(k) for k in keys})
    return agg.select(*keys, *[F.col("__r")[c].alias(c) for c in others], F.col("__r.__o").alias(order))


def forward_corpus(clean: DataFrame, canonicalise="default", max_len: int = 512,
                   restored: DataFrame | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """Product-prediction corpus (T6 order of steps).

    PRODUCT not null -> (union restored) -> blank-fill roles -> REACTANT
    present -> first PRODUCT per (REACTANT, CATALYST, REAGENT, SOLVENT) ->
    REAGENT = CATALYST.REAGENT.SOLVENT -> canonicalise REAGENT -> prompt ->
    length <= max_len.  The 5-column distinct of the reference is implied
    by first-per-key (the earliest row of a key is the earliest row of its
    own 5-tuple).  ``shuffle_seed``: "first" in a seeded order instead of the
    source order, so that restored rows can win too.
    """
    df = clean.where(F.col("PRODUCT").isNotNull())
    if restored is not None:
        df = df.unionByName(restored, allowMissingColumns=True)
    cols = ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT"]
    df = df.select("row_id", *[rx.fill_blank(c).alias(c) for c in cols])
    df = df.where(F.col("REACTANT") != BLANK)
    df = first_per_key(df, ["REACTANT", "CATALYST", "REAGENT", "SOLVENT"], shuffle_seed=shuffle_seed)
    return forward_prompt(df, canonicalise).where(F.length("input") <= max_len)


def forward_prompt(df: DataFrame, canonicalise="default") -> DataFrame:
    """Merged, canonical REAGENT and the prompt of the product-prediction corpus."""
    df = df.withColumn("REAGENT", rx.merge_reagents("CATALYST", "REAGENT", "SOLVENT"))
    fn = sm.canonical_fragments if canonicalise == "default" else canonicalise
    df = dictionary_apply(df, "REAGENT", "REAGENT", fn, keep=lambda c: c != F.lit(BLANK))
    df = once(df, {"REAGENT": F.col("REAGENT")})  # canonical text is dear; the prompt's length is asked for besides
    df = df.withColumn("input", rx.build_prompt(("REACTANT", "REACTANT"), ("REAGENT", "REAGENT")))
    return df.select("row_id", "REACTANT", "PRODUCT", "CATALYST", "REAGENT", "SOLVENT", "input")


def four_role_corpus(clean: DataFrame, max_len: int = 512) -> DataFrame:
    """Prompt over all four input roles, each kept apart: first product per key, blanks filled, length limit."""
    roles = ["REACTANT", "CATALYST", "REAGENT", "SOLVENT"]
    df = clean.where(F.col("PRODUCT").isNotNull()).select("row_id", *[rx.fill_blank(c).alias(c) for c in [*roles, "PRODUCT"]])
    df = first_per_key(df.where(F.col("REACTANT") != BLANK), roles)
    df = df.withColumn("input", rx.build_prompt(*[(r, r) for r in roles]))
    return df.where(F.length("input") <= max_len).select("row_id", *roles, "PRODUCT", "input")


def finetune_yield_corpus(rows: DataFrame) -> DataFrame:
    """(input, YIELD) from REACTANT, REAGENT, PRODUCT and a yield in percent, clipped to 0..100 and divided by 100."""
    share = F.least(F.greatest(F.col("YIELD"), F.lit(0.0)), F.lit(100.0)) / 100
    parts = rows.where(F.col("YIELD").isNotNull()).select(
        "row_id", *[rx.fill_blank(c).alias(c) for c in ("REACTANT", "REAGENT", "PRODUCT")], share.alias("YIELD"))
    return parts.select("row_id", rx.build_prompt(*[(c, c) for c in ("REACTANT", "REAGENT", "PRODUCT")]).alias("input"), "YIELD")


def finetune_forward_corpus(rows: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """(input, PRODUCT) from REACTANT and REAGENT; with ``n`` exactly that many rows, drawn by seed."""
    from retort.plans.rowindex import sample_n
    df = rows.where(F.col("PRODUCT").isNotNull() & F.col("REACTANT").isNotNull()).select(
        "row_id", "REACTANT", rx.fill_blank("REAGENT").alias("REAGENT"), "PRODUCT")
    df = df.withColumn("input", rx.build_prompt(("REACTANT", "REACTANT"), ("REAGENT", "REAGENT")))
    df = df.select("row_id", "input", "PRODUCT")
    return df if n is None else sample_n(df, ["row_id"], n, seed)


def retro_corpus(clean: DataFrame, canonicalise="default", max_len: int = 512) -> DataFrame:
    """Retrosynthesis corpus: same selection as forward, prompt PRODUCT:..REAGENT:.., target REACTANT."""
    df = clean.where(F.col("PRODUCT").isNotNull())
    cols = ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT"]
    df = df.select("row_id", *[rx.fill_blank(c).alias(c) for c in cols])
    df = df.where(F.col("REACTANT") != BLANK)
    df = first_per_key(df, ["REACTANT", "CATALYST", "REAGENT", "SOLVENT"])
    df = df.withColumn("REAGENT", rx.merge_reagents("CATALYST", "REAGENT", "SOLVENT"))
    fn = sm.canonical_fragments if canonicalise == "default" else canonicalise
    df = dictionary_apply(df, "REAGENT", "REAGENT", fn, keep=lambda c: c != F.lit(BLANK))
    df = once(df, {"REAGENT": F.col("REAGENT")})
    df = df.withColumn("input", rx.build_prompt(("PRODUCT", "PRODUCT"), ("REAGENT", "REAGENT")))
    return df.where(F.length("input") <= max_len).select(
        "row_id", "REACTANT", "PRODUCT", "CATALYST", "REAGENT", "SOLVENT", "input")


def yield_corpus(clean: DataFrame, canonicalise="default", max_len: int = 512) -> DataFrame:
    """Yield-regression corpus: (input, YIELD), one input may carry several yields.

    distinct(all) -> YIELD not null -> not YIELD > 100 (negatives kept) ->
    /100 -> REACTANT and PRODUCT not null -> blank fill -> REAGENT =
    CATALYST.REAGENT -> canonicalise REACTANT/REAGENT/PRODUCT -> prompt ->
    distinct (input, YIELD) -> length.  SOLVENT is unused.  The final
    distinct subsumes the first, so only one dedup shuffle runs.
    """
    df = clean.where(F.col("YIELD").isNotNull() & ~(F.col("YIELD") > 100))
    df = df.where(F.col("REACTANT").isNotNull() & F.col("PRODUCT").isNotNull())
    df = df.select((F.col("YIELD") / 100).alias("YIELD"),
                   *[rx.fill_blank(c).alias(c) for c in ["CATALYST", "REACTANT", "REAGENT", "PRODUCT"]])
    df = df.withColumn("REAGENT", rx.merge_reagents("CATALYST", "REAGENT"))
    fn = sm.canonical_fragments if canonicalise == "default" else canonicalise
    df = dictionary_apply_all(df, ["REACTANT", "REAGENT", "PRODUCT"], fn, keep=lambda x: x != F.lit(BLANK))
    df = once(df, {"input": rx.build_prompt(("REACTANT", "REACTANT"), ("REAGENT", "REAGENT"), ("PRODUCT", "PRODUCT"))})
    df = df.select("input", "YIELD")
    df = df.where(F.col("input").isNotNull()).distinct()
    return df.where(F.length("input") <= max_len)
