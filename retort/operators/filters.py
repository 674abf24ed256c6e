"""Row filters, projections and label predicates (all pushdown-friendly)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.schema import BLANK


def select_columns(df: DataFrame, cols: list) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: list) -> DataFrame:
    return df.drop(*cols)


def require_not_null(df: DataFrame, cols: list, any_of: bool = False) -> DataFrame:
    """Drop rows where a column is null (``any_of``: keep if at least one is set)."""
    conds = [F.col(c).isNotNull() for c in cols]
    cond = conds[0]
    for c in conds[1:]:
        cond = (cond | c) if any_of else (cond & c)
    return df.where(cond)


def require_null(df: DataFrame, cols: list) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNull()
    return df.where(cond)


def rows_with_uncategorised(df: DataFrame, col: str = "NoData") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def drop_over_100_yield(df: DataFrame, col: str = "YIELD") -> DataFrame:
    """Keep rows that are not above 100 (negatives kept; null kept: ~(null>100) is null -> dropped)."""
    return df.where(~(F.col(col) > 100))


def require_role_present(df: DataFrame, col: str = "REACTANT") -> DataFrame:
    return df.where(F.col(col) != F.lit(BLANK))


def max_chars(df: DataFrame, col: str = "input", n: int = 512) -> DataFrame:
    """length <= n; a null text (failed compound) is dropped too."""
    return df.where(F.length(col) <= n)


def fold_filter(df: DataFrame, fold: int = 0, fold_col: str = "fold", split_col: str = "split") -> DataFrame:
    """fold == k -> 'valid', else 'train' (one pass, no second scan)."""
    return df.withColumn(split_col, F.when(F.col(fold_col) == fold, "valid").otherwise("train"))


def label_filter(df: DataFrame, col: str = "target", exclude=None, keep=None) -> DataFrame:
    if exclude is not None:
        df = df.where(~F.col(col).isin(list(exclude)))
    if keep is not None:
        df = df.where(F.col(col).isin(list(keep)))
    return df


def binarise_label(df: DataFrame, col: str = "target", positive: int = 1) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == positive, 1).otherwise(0))


def invert_label(df: DataFrame, col: str = "target") -> DataFrame:
    return df.withColumn(col, F.lit(1) - F.col(col))


def drop_blank_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """Non-empty and not whitespace-only (Python ``str.isspace`` whitespace)."""
    return df.where(F.length(F.regexp_replace(F.col(col), r"\s", "")) > 0)


def threshold_label(df: DataFrame, score: str, t: float = 0.97, out: str = "pred") -> DataFrame:
    """Strict ``score > t``."""
    return df.withColumn(out, F.col(score) > F.lit(t))


def fill_blank_roles(df: DataFrame, cols: list) -> DataFrame:
    return df.fillna(BLANK, subset=list(cols))
