"""dictionary_apply: run a per-compound function once per distinct value.

The reference calls a chemistry function on every row.  Here the distinct
values of the column are computed (partial aggregation collapses hot
values map-side), the function runs once per distinct value, and the
result is joined back on the value.  AQE turns the join into a broadcast
when the dictionary is small at run time and splits skewed join
partitions when one compound dominates, so the plan holds when a single
compound covers a third of all rows.

A function is either

* a Column function ``Column -> Column`` (built-in expressions: applied
  inline, no dictionary needed — it is already vectorised), or
* a batch function ``pandas.Series -> pandas.Series`` registered with
  ``compound_function`` (e.g. an RDKit canonicaliser on a cluster that has
  it).  It runs in Arrow batches through ``mapInPandas`` over the distinct
  values only.

A dictionary can be stored: later runs compute only the values it lacks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 64  # groups over which rows of equal values are spread
_REGISTRY: dict[str, "CompoundFunction"] = {}


class CompoundFunction:
    def __init__(self, name: str, fn: Callable, return_type: str = "string", batch: bool = True):
        self.name, self.fn, self.return_type, self.batch = name, fn, return_type, batch


def compound_function(name: str, fn: Callable, return_type: str = "string") -> CompoundFunction:
    """Register a batch ``Series -> Series`` function under ``name``."""
    cf = CompoundFunction(name, fn, return_type, batch=True)
    _REGISTRY[name] = cf
    return cf


def get_function(name: str) -> CompoundFunction:
    return _REGISTRY[name]


def dictionary_apply(df: DataFrame, in_col: str, out_col: str, fn, keep=None, store: str | None = None) -> DataFrame:
    """Add ``out_col = fn(in_col)``, computing fn once per distinct ``in_col``.

    ``keep``: optional predicate Column-function; rows failing it keep
    their input unchanged (the corpus guard ``x != ' '``).  ``store``: as
    for ``dictionary_apply_all``.
    """
    if isinstance(fn, str):
        fn = _REGISTRY[fn]
    if not isinstance(fn, CompoundFunction):
        out = fn(F.col(in_col))
        if keep is not None:
            out = F.when(keep(F.col(in_col)), out).otherwise(F.col(in_col))
        return df.withColumn(out_col, out)

    key = "__dict_key"
    wanted = F.col(key).isNotNull() if keep is None else F.col(key).isNotNull() & keep(F.col(key))
    distinct = df.select(F.col(in_col).alias(key)).where(wanted).distinct()
    joined = df.join(_dictionary(distinct, fn, store), df[in_col] == F.col(key), "left")
    out = F.col("__dict_val")
    if keep is not None:
        out = F.when(keep(F.col(in_col)), out).otherwise(F.col(in_col))
    return joined.withColumn(out_col, out).drop(key, "__dict_val")


def dictionary_apply_all(df: DataFrame, cols: list, fn, keep=None, store: str | None = None, spread: list | None = None) -> DataFrame:
    """``fn`` on several columns, computed once for each value that is distinct over all of them.

    Long form: the values of a row go into narrow (row key, value) rows, one
    join looks them up, and one aggregate brings a row's values back as a map
    from value to result.  So the rows themselves move once, however many
    columns there are.  The row key is a hash of the row's values and a salt of
    ``spread`` (all columns by default), so equal rows of values share maps
    without all meeting in one task; rows whose keys agree by chance share a
    map that holds the values of both, which changes no result.

    ``store``: a Parquet folder that keeps the dictionary between runs; only
    values it does not hold yet are computed, and are appended to it.
    """
    if isinstance(fn, str):
        fn = _REGISTRY[fn]
    if not isinstance(fn, CompoundFunction):
        for c in cols:
            df = dictionary_apply(df, c, c, fn, keep)
        return df
    row, key, found = "__dict_row", "__dict_key", "__dict_map"
    salt = F.pmod(F.xxhash64(*(spread or [c for c, t in df.dtypes if "map<" not in t])), F.lit(SALTS))
    rows = df.withColumn(row, F.xxhash64(*cols, salt))
    wanted = F.col(key).isNotNull() if keep is None else F.col(key).isNotNull() & keep(F.col(key))
    values = rows.select(row, F.explode(F.array_distinct(F.array(*cols))).alias(key)).where(wanted)
    words = _dictionary(values.select(key).distinct(), fn, store)
    entry = F.struct(key, "__dict_val")
    maps = values.join(words, key).groupBy(row).agg(F.map_from_entries(F.collect_set(entry)).alias(found))
    out = rows.join(maps, row, "left")
    new = {}
    for c in cols:
        new[c] = F.try_element_at(F.col(found), F.col(c))
        if keep is not None:
            new[c] = F.when(keep(F.col(c)), new[c]).otherwise(F.col(c))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def read_dictionary(spark: SparkSession, store: str, fn: CompoundFunction) -> DataFrame:
    """The stored (__dict_key, __dict_val) pairs; empty when nothing is stored.  Keys that two runs added at once count once."""
    schema = f"__dict_key string, __dict_val {fn.return_type}"
    try:
        return spark.read.schema(schema).parquet(store).dropDuplicates(["__dict_key"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _dictionary(distinct: DataFrame, fn: CompoundFunction, store: str | None = None) -> DataFrame:
    """(__dict_key, __dict_val): the batch function over distinct values, or over those that ``store`` lacks."""
    key, rtype = "__dict_key", fn.return_type
    user_fn = fn.fn

    def run(batches):
        for pdf in batches:
            pdf["__dict_val"] = user_fn(pdf[key])
            yield pdf

    schema = f"{key} string, __dict_val {rtype}"
    if store is None:
        return distinct.mapInPandas(run, schema)
    known = read_dictionary(distinct.sparkSession, store, fn)
    distinct.join(known, key, "left_anti").mapInPandas(run, schema).write.mode("append").parquet(store)
    return read_dictionary(distinct.sparkSession, store, fn)
