"""Reaction-string expressions: role parsing, products, conditions, prompts.

All helpers return ``Column`` objects built from built-in Spark functions
(higher-order array functions where a list is involved), so they stay
inside whole-stage codegen and work unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.schema import BLANK, ROLES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def role_of(item: Column) -> Column:
    """Role name of one '.'-item: the first role (fixed order) that occurs as a substring."""
    expr = None
    for r in ROLES:
        cond = F.instr(item, r) > 0
        expr = F.when(cond, F.lit(r)) if expr is None else expr.when(cond, F.lit(r))
    return expr


def _tail(item: Column) -> Column:
    """Text after the first ':' (the whole text when there is none)."""
    return item.substr(F.instr(item, ":") + 1, F.length(item) + 1)


def tagged_items(input_col, mode: str = "strict") -> Column:
    """``input`` -> array<struct<r:string,v:string>> of (role, compound) items.

    ``mode='strict'``: an item without a role name is dropped (null role).
    ``mode='carry'``: it is attached to the role of the previous item.
    """
    items = F.split(_c(input_col), r"\.")
    if mode == "strict":
        return F.transform(items, lambda x: F.struct(role_of(x).alias("r"), _tail(x).alias("v")))
    if mode != "carry":
        raise ValueError("mode must be 'strict' or 'carry'")
    start = F.struct(F.lit(None).cast("string").alias("last"),
                     F.array().cast("array<struct<r:string,v:string>>").alias("out"))

    def step(acc, x):
        r = role_of(x)
        role = F.coalesce(r, acc["last"])
        val = F.when(r.isNull(), x).otherwise(_tail(x))
        return F.struct(role.alias("last"),
                        F.array_append(acc["out"], F.struct(role.alias("r"), val.alias("v"))).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def role_column(items: Column, role: str) -> Column:
    """'.'-joined compounds of one role; '' when none (as the reference writes)."""
    picked = F.transform(F.filter(items, lambda p: p["r"] == F.lit(role)), lambda p: p["v"])
    return F.coalesce(F.array_join(picked, "."), F.lit(""))


def parse_products(product_col) -> Column:
    """'PRODUCT:a.PRODUCT:b' -> 'a.b'; null stays null."""
    p = F.replace(_c(product_col), F.lit(".PRODUCT"), F.lit("PRODUCT"))
    parts = F.filter(F.split(p, "PRODUCT:"), lambda x: x != F.lit(""))
    return F.array_join(parts, ".")


def parse_condition(cond_col) -> tuple[Column, Column]:
    """'YIELD:y.TEMP:t' / 'YIELD:y' / 'TEMP:t' -> (YIELD double, TEMP double).

    Both words: cut at the first '.T'.  Neither word (e.g. 'NONE') or an
    unparsable number gives null (the reference would stop there).
    """
    c = _c(cond_col)
    has_y = F.instr(c, "YIELD") > 0
    has_t = F.instr(c, "TEMP") > 0
    pos = F.instr(c, ".T")
    head = c.substr(F.lit(1), pos - 1)
    tail = c.substr(pos, F.length(c) + 1)
    num = lambda s: _tail(s).try_cast("double")
    y = F.when(has_y & has_t, num(head)).when(has_y, num(c))
    t = F.when(has_y & has_t, num(tail)).when(has_t, num(c))
    return y, t


def empty_as_null(c) -> Column:
    """'' -> null: what a CSV round trip does to an empty cell."""
    return F.nullif(_c(c), F.lit(""))


def space_clean(c) -> Column:
    """Three literal replaces in order: '. ' -> '', ' .' -> '', '  ' -> ' '."""
    x = F.replace(_c(c), F.lit(". "), F.lit(""))
    x = F.replace(x, F.lit(" ."), F.lit(""))
    return F.replace(x, F.lit("  "), F.lit(" "))


def merge_reagents(*cols) -> Column:
    """Join role columns with '.', then ``space_clean`` (blank roles vanish)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("."))
        parts.append(_c(c))
    return space_clean(F.concat(*parts))


def build_prompt(*pairs) -> Column:
    """build_prompt(('REACTANT', col), ('REAGENT', col), ...) -> 'REACTANT:..REAGENT:..'.

    Null-propagating on purpose: a failed compound makes the prompt null.
    """
    parts = []
    for tag, c in pairs:
        parts += [F.lit(f"{tag}:"), _c(c)]
    return F.concat(*parts)


def build_flat_input(reactant, reagent, product) -> Column:
    """REACTANT.REAGENT.PRODUCT with every (any char + blank) pair removed."""
    s = F.concat(_c(reactant), F.lit("."), _c(reagent), F.lit("."), _c(product))
    return F.regexp_replace(s, r". ", "")


def untag_prompt(c) -> Column:
    """Tagged prompt -> plain '.'-joined compounds: tags become '.', then blanks go."""
    x = F.replace(_c(c), F.lit("REACTANT:"), F.lit(""))
    x = F.replace(x, F.lit("REAGENT:"), F.lit("."))
    x = F.replace(x, F.lit("PRODUCT:"), F.lit("."))
    return F.regexp_replace(x, r". ", "")


def clean_generated(c) -> Column:
    """Decoded model output: drop blanks, strip trailing dots."""
    return F.rtrim(F.replace(_c(c), F.lit(" "), F.lit("")), F.lit("."))


def char_spacing(c) -> Column:
    """'CCO' -> 'C C O'."""
    return F.array_join(F.split(_c(c), ""), " ")


def generation_bounds(prompt, margin: int = 20) -> tuple[Column, Column]:
    """(min_len, max_len) from a prompt: reactant length +/- margin, floor 0."""
    p = _c(prompt)
    base = F.instr(p, "REAGENT") - F.instr(p, ":")
    return F.greatest(base - margin, F.lit(0)), base + margin


def stringify(c) -> Column:
    return _c(c).cast("string")


def clip(c, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Clamp into [lo, hi]; null stays null."""
    x = _c(c)
    return F.when(x.isNull(), x).otherwise(F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def fill_blank(c) -> Column:
    return F.coalesce(_c(c), F.lit(BLANK))
