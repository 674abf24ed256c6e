"""Declared schemas and fixed vocabularies of the reaction data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Role names in the order roles are matched (first substring
# hit wins) and in the order of the integer role codes 0..5.
ROLES = ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "INTERNAL_STANDARD", "NoData"]

# Columns of a parsed ("clean") reaction table, in file order.
CLEAN_COLUMNS = ROLES + ["PRODUCT", "YIELD", "TEMP"]

BLANK = " "  # known-empty role sentinel (what fillna(' ') produces)

RAW_REACTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("condition", T.StringType()),
])

CLEAN_REACTIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ROLES + ["PRODUCT"]]
    + [T.StructField("YIELD", T.DoubleType()), T.StructField("TEMP", T.DoubleType())]
)

FORWARD_DEMO = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("REACTANT", T.StringType()),
    T.StructField("PRODUCT", T.StringType()),
    T.StructField("CATALYST", T.StringType()),
    T.StructField("REAGENT", T.StringType()),
    T.StructField("SOLVENT", T.StringType()),
    T.StructField("input", T.StringType()),
])

YIELD_DEMO = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("YIELD", T.IntegerType()),
])


def require_columns(df, cols) -> None:
    """Fail early, with the missing names, when a required column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; have {df.columns}")
