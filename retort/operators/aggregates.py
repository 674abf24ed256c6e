"""Plain aggregations: counts, profiles, histograms, stage counts."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, cols: list | None = None) -> DataFrame:
    return df.select(*cols).distinct() if cols else df.distinct()


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Counts per value, largest first (value as tie-break)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(col))


PIVOTS, FEW = 64, 4096


def _value_at(values: DataFrame, n: int, rank: int) -> float:
    """The ``rank``-th smallest of ``n`` values, by narrowing: a round takes pivots (approximate percentiles, which
    are values of the table), counts exactly what is below and up to each, and goes on between two of them."""
    x, part = F.col("x"), values
    while n > FEW:
        pivots = sorted(set(part.agg(F.percentile_approx(x, [i / PIVOTS for i in range(1, PIVOTS)], 1000)).first()[0]))
        counts = part.agg(*[F.count_if(x < p) for p in pivots], *[F.count_if(x <= p) for p in pivots]).first()
        below, upto = counts[:len(pivots)], counts[len(pivots):]
        at = sum(b <= rank for b in below) - 1
        if at >= 0 and rank < upto[at]:
            return pivots[at]
        begin = upto[at] if at >= 0 else 0
        end = below[at + 1] if at + 1 < len(pivots) else n
        if at >= 0:
            part = part.where(x > pivots[at])
        if at + 1 < len(pivots):
            part = part.where(x < pivots[at + 1])
        n, rank = end - begin, rank - begin
    return part.orderBy("x").collect()[rank]["x"]


def exact_quantiles(df: DataFrame, col, shares: list) -> list:
    """Exact quantiles with linear interpolation (null where there is no value).

    The column alone is written once; each wanted rank is narrowed down by
    counting (``_value_at``), so no task or buffer holds all values.
    """
    from retort.session import checkpoint_dir, drop_path, stage_path
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = stage_path(spark, f"quantiles-{uuid.uuid4().hex}")
    x = F.col(col) if isinstance(col, str) else col
    df.select(x.cast("double").alias("x")).where(F.col("x").isNotNull()).write.parquet(path)
    values = spark.read.schema("x double").parquet(path)
    n, found, out = values.count(), {}, []
    for share in shares:
        place = (n - 1) * share
        low, high = math.floor(place), math.ceil(place)
        for rank in {low, high} - found.keys() if n else ():
            found[rank] = _value_at(values, n, rank)
        out.append(None if not n else found[low] if low == high else (high - place) * found[low] + (place - low) * found[high])
    drop_path(spark, path)
    return out


def length_profile(df: DataFrame, col: str) -> DataFrame:
    """count/mean/std/min/quartiles/max of a numeric column (pandas ``describe``).

    Quartiles use linear interpolation, exact (``exact_quantiles``).
    """
    x = F.col(col).cast("double")
    quartiles = [F.lit(v).cast("double").alias(name) for name, v in
                 zip(("p25", "p50", "p75"), exact_quantiles(df, x, [0.25, 0.5, 0.75]))]
    sums = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max"))
    return sums.select("count", "mean", "std", "min", *quartiles, "max")


def length_histogram(df: DataFrame, col: str, bins: int = 1000) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (numpy/pandas ``hist``).

    min/max come from one single-row aggregate, attached by an equi-join on
    a constant key (broadcast: one row); bin = least(floor((x-min)/w), bins-1).
    Output: non-empty bins (bin, lower edge, n).
    """
    x = F.col(col).cast("double")
    vals = df.select(x.alias("__x")).where(F.col("__x").isNotNull()).withColumn("__k", F.lit(1))
    stats = vals.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).withColumn("__k", F.lit(1))
    j = vals.join(F.broadcast(stats), "__k")
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    g = j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("__lo").alias("__lo"),
                                      F.first("__hi").alias("__hi"))
    lower = F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    return g.select("bin", F.round(lower, 6).alias("lower"), "n")


def stage_conditions(conditions: dict) -> dict:
    """name -> Column counting the rows that pass this and all earlier conditions (None: all rows)."""
    out, passed = {}, F.lit(True)
    for name, c in conditions.items():
        passed = passed if c is None else passed & F.coalesce(c, F.lit(False))
        out[name] = F.count_if(passed)
    return out


def corpus_counts(*parts: tuple) -> DataFrame:
    """(stage, n) after each named stage; each part is (df, {stage: condition}), counted in one pass over df.

    Only a stage that is not a row condition (a dedup) needs a new part.
    """
    out = None
    for df, conditions in parts:
        counts = stage_conditions(conditions)
        rows = F.array(*[F.struct(F.lit(name).alias("stage"), c.alias("n")) for name, c in counts.items()])
        one = df.agg(rows.alias("r")).select(F.inline("r"))
        out = one if out is None else out.unionByName(one)
    return out


def observe_counts(df: DataFrame, name: str, conditions: dict):
    """(df, observation): the same counts as metrics of whatever job reads ``df``, without a pass of their own."""
    from pyspark.sql import Observation
    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in stage_conditions(conditions).items()]), watch


def step_metric_mean(df: DataFrame, step: str, metrics: list) -> DataFrame:
    return df.groupBy(step).agg(*[F.avg(m).alias(m) for m in metrics])
