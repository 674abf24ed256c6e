"""Compound-role label tables (classification dataset)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.schema import ROLES


def explode_compounds(clean: DataFrame, roles=None) -> DataFrame:
    """Role columns -> distinct (smiles, target=role code, ord).

    ``ord`` = (code, row_id, pos) of the first occurrence, the order in
    which the reference builds its list (column by column, row by row).
    A compound that is in a third of all rows (water, say) is reduced by
    partial aggregation before the shuffle.
    """
    roles = roles or ROLES
    arr = F.array(*[F.struct(F.lit(i).alias("code"), F.col(r).alias("v")) for i, r in enumerate(roles)])
    x = clean.select("row_id", F.inline(arr)).where(F.col("v").isNotNull())
    x = x.select("row_id", "code", F.posexplode(F.split("v", r"\.")).alias("pos", "smiles"))
    return (x.groupBy("smiles", F.col("code").alias("target"))
            .agg(F.min(F.struct("code", "row_id", "pos")).alias("ord")))


def label_filter(df: DataFrame, exclude=(4, 5), col: str = "target") -> DataFrame:
    return df.where(~F.col(col).isin(list(exclude)))


def binary_labels(clean: DataFrame, positive: int = 1) -> DataFrame:
    """Targets 4/5 removed, target == positive -> 1 else 0, deduplicated (first occurrence kept)."""
    x = label_filter(explode_compounds(clean))
    x = x.withColumn("target", F.when(F.col("target") == positive, 1).otherwise(0))
    return x.groupBy("smiles", "target").agg(F.min("ord").alias("ord")).select("smiles", "target")


def binary_labels_ordered(clean: DataFrame, positive: int = 1) -> DataFrame:
    x = label_filter(explode_compounds(clean))
    x = x.withColumn("target", F.when(F.col("target") == positive, 1).otherwise(0))
    x = x.groupBy("smiles", "target").agg(F.min("ord").alias("ord"))
    return x.select("smiles", "target", F.col("ord.code").alias("o_code"),
                    F.col("ord.row_id").alias("o_row"), F.col("ord.pos").alias("o_pos"))


def invert_label(df: DataFrame, col: str = "target") -> DataFrame:
    return df.withColumn(col, F.lit(1) - F.col(col))
