"""Role restoration: route uncategorised compounds back into role columns.

For each reaction with a NoData list, every compound is looked up in a
prediction table (smiles -> pred) and appended, in its original order,
to ``true_role`` (pred true) or ``false_role`` (pred false) after the
text already there.  The reference's code routes True to REACTANT while
its label polarity says REAGENT (T11), so the caller names the role.

Plan: explode (reaction id, position, compound) only -> equi-join
predictions (AQE: broadcast when small, skew split when one compound
dominates) -> one short list per reaction id and direction -> join back to
the reactions.  The reactions' own texts go through one join, not through
the explode.  A reaction's list is bounded by its own NoData text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators.joins import lookup_join


def restore_roles(df: DataFrame, predictions: DataFrame, true_role: str, false_role: str | None = None,
                  nodata: str = "NoData", key: str = "smiles", pred: str = "pred", id_col: str = "row_id",
                  on_missing: str = "error") -> DataFrame:
    """``on_missing``: a compound without a prediction fails the job ('error') or stays in ``nodata`` ('keep').

    With 'keep', ``nodata`` holds just the compounds that were not routed (null if none).
    """
    if on_missing not in ("error", "keep"):
        raise ValueError(f"on_missing must be 'error' or 'keep', not {on_missing!r}")
    if false_role is None:
        false_role = "REAGENT" if true_role == "REACTANT" else "REACTANT"
    x = (df.where(F.col(nodata).isNotNull())
         .select(id_col, F.posexplode(F.split(F.col(nodata), r"\.")).alias("__pos", key)))
    x = lookup_join(x, predictions.select(key, pred), key, on_missing=on_missing)
    item = F.struct(F.col("__pos"), F.col(key))
    lists = {"__t": F.col(pred), "__f": ~F.col(pred), "__n": F.col(pred).isNull()}
    g = x.groupBy(id_col).agg(*[F.array_sort(F.collect_list(F.when(c, item))).alias(n) for n, c in lists.items()])
    out = df.join(g, id_col, "left")

    def text(items):
        return F.nullif(F.array_join(F.transform(F.col(items), lambda s: s[key]), "."), F.lit(""))

    def joined(base, items):
        return F.nullif(F.concat_ws(".", F.col(base), text(items)), F.lit(""))

    made = {true_role: joined(true_role, "__t"), false_role: joined(false_role, "__f")}
    if on_missing == "keep":
        made[nodata] = text("__n")
    return out.withColumns(made).drop(*lists)
