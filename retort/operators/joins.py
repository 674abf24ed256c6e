"""Joins: dictionary lookup, positional, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str, value_cols: list, order: str) -> DataFrame:
    """Per key, the values of the row that comes last in ``order`` (dict-overwrite semantics).

    An aggregate (``max_by``) so partial aggregation collapses hot keys
    before the shuffle.
    """
    packed = F.struct(*[F.col(c) for c in value_cols])
    agg = df.groupBy(key).agg(F.max_by(packed, F.col(order)).alias("__v"))
    return agg.select(key, *[F.col("__v")[c].alias(c) for c in value_cols])


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, on_missing: str = "error",
                lookup_order: str | None = None) -> DataFrame:
    """Left equi-join ``df`` with a key -> value lookup table.

    ``lookup_order``: when the lookup has repeated keys, the last row in
    this order wins (dict semantics); otherwise keys must be unique.
    ``on_missing``: 'error' makes the job fail if some non-null key has no
    entry, 'keep' leaves nulls, 'drop' removes rows.

    No broadcast hint: the dictionary can grow with the data.  AQE
    converts the join to a broadcast at run time when the lookup side is
    small and splits skewed partitions when one key dominates.
    """
    if lookup_order is not None:
        vals = [c for c in lookup.columns if c not in (key, lookup_order)]
        lookup = last_per_key(lookup, key, vals, lookup_order)
    vals = [c for c in lookup.columns if c != key]
    marked = lookup.withColumn("__hit", F.lit(True))
    out = df.join(marked, key, "left")
    if on_missing == "error":
        absent = F.col(key).isNotNull() & F.col("__hit").isNull()
        fail = F.raise_error(F.concat(F.lit("lookup has no entry for "), F.col(key).cast("string")))
        # in the kept column, not only in the dropped mark, so that the check cannot be optimised away
        out = out.withColumns({v: F.when(absent, fail.cast(out.schema[v].dataType)).otherwise(F.col(v)) for v in vals})
    elif on_missing == "drop":
        out = out.where(F.col("__hit").isNotNull())
    return out.drop("__hit")


def positional_join(left: DataFrame, right: DataFrame, index_col: str = "row_id", how: str = "inner") -> DataFrame:
    """Copy columns across two tables by row position (both carry ``index_col``)."""
    return left.join(right, index_col, how)


def fan_out_join(outputs: DataFrame, inputs: DataFrame, k: int, pos_col: str = "pos",
                 index_col: str = "row_id") -> DataFrame:
    """Attach input row ``floor(pos / k)`` to each of the k outputs per input."""
    o = outputs.withColumn(index_col, F.floor(F.col(pos_col) / k).cast("long"))
    return o.join(inputs, index_col, "inner")
