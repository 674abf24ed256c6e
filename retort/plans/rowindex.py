"""global_index and everything built on exact positions.

An exact 0-based row position (``idx``) in a total order, optionally
restarting per group, without a single-task window:

1. each row gets a *bucket* that is monotone in the order — a range
   partition id (``repartitionByRange``), or, for md5 orders, a prefix of
   the md5 key (uniform by construction, no sampling pass); in one order
   without groups the sorted ranges are written with each row's place, and
   steps 2 and 3 are a sum over the ranges;
2. per-(group, bucket) counts form a small table; a running sum over it
   gives each bucket's starting offset and each group's total;
3. ``row_number`` inside (group, bucket) plus the bucket offset is the
   position.  A hot group is spread over many buckets, so no task holds
   more than about N / buckets rows.

Folds, oversampling and batch ids are then plain predicates on ``idx`` and
the group total ``n``.  Splits, samples and slices need no positions: they
select the keys at their cut-off ranks (``cut_offs``) and compare.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retort.functions.hashing import hash_key

IDX, TOTAL = "idx", "n"


def _range_buckets(df: DataFrame, nb: int, sort_cols: list) -> DataFrame:
    """Rows with ``__b`` = their range-partition id, materialised once.

    The bucket ids come from sampled range bounds; the plan reads the
    bucketed rows twice (counts and rows), so they are written once with a
    reliable ``checkpoint()`` into the session's checkpoint folder.  Both
    reads then see the same assignment, also after an executor loss.
    """
    from retort.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    b = df.repartitionByRange(nb, *sort_cols).withColumn("__b", F.spark_partition_id())
    return b.checkpoint(eager=True)


def _default_buckets(df: DataFrame) -> int:
    try:
        return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4, 16)
    except Exception:  # pragma: no cover
        return 64


def global_index(df: DataFrame, order: list, by: list | None = None, bucket: Column | None = None,
                 buckets: int | None = None, index_col: str = IDX, total_col: str | None = TOTAL) -> DataFrame:
    """Add ``index_col`` = 0-based position in ``order`` (within ``by`` groups).

    ``order`` must be a total order (add a unique key as the last column).
    ``bucket``: an integer Column monotone in ``order``; when omitted the
    rows are range-partitioned on (by, order) into ``buckets`` ranges.
    ``total_col``: also add the group size (None to skip).
    """
    by = list(by or [])
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if bucket is None and not by:
        return _placed(df, order_cols, buckets or _default_buckets(df), index_col, total_col)
    if bucket is None:
        nb = buckets or _default_buckets(df)
        sort_cols = [F.col(c) for c in by] + order_cols
        b = _range_buckets(df, nb, sort_cols)
    else:
        b = df.withColumn("__b", bucket)
    counts = b.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    wb = Window.partitionBy(*by).orderBy("__b")
    offs = counts.select(
        *by, "__b",
        F.coalesce(F.sum("__cnt").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__cnt").over(Window.partitionBy(*by)).alias("__tot"))
    joined = b.join(offs, on=by + ["__b"], how="inner")
    w = Window.partitionBy(*by, "__b").orderBy(*order_cols)
    out = joined.withColumn(index_col, F.row_number().over(w) - 1 + F.col("__off"))
    if total_col:
        out = out.withColumn(total_col, F.col("__tot"))
    return out.drop("__b", "__off", "__tot")


def _placed(df: DataFrame, order_cols: list, ranges: int, index_col: str, total_col: str | None) -> DataFrame:
    """Positions in one order: rows are dealt into sorted ranges and written with their place in their range.

    The place is the lower part of Spark's row number, the range its upper
    part, so no window is needed; the rows before each range (one number per
    range) are summed on the driver.  Rows are exchanged once.
    """
    from retort.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    b = (df.repartitionByRange(ranges, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("__at", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright("__at", 33).cast("int")
    counts = {r["p"]: r["c"] for r in b.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    start = F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), part)
    out = b.withColumn(index_col, start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return (out.withColumn(total_col, F.lit(total).cast("long")) if total_col else out).drop("__at")


FEW_POSITIONS = 200_000


def positions(df: DataFrame, order: list, index_col: str = IDX) -> DataFrame:
    """Only the ``order`` columns and the position: a narrow table to join with; hinted for broadcast while it is small."""
    x = global_index(df.select(*order), order, index_col=index_col)
    first = x.select(TOTAL).first()
    x = x.drop(TOTAL)
    return F.broadcast(x) if (first[0] if first else 0) <= FEW_POSITIONS else x


def hash_index(df: DataFrame, seed: int, key_cols: list, by: list | None = None,
               prefix_hex: int | None = None, index_col: str = IDX, total_col: str | None = TOTAL) -> DataFrame:
    """Position in the seeded md5 order of ``key_cols`` (unique key), bucketed by md5 prefix.

    md5 is uniform, so the prefix is a balanced, order-preserving bucket
    without a sampling pass.  The prefix length follows the cluster's
    shuffle parallelism (about 4 buckets per shuffle partition, at least
    16^3), so bucket size stays bounded as data and cluster grow.
    """
    if prefix_hex is None:
        prefix_hex = max(3, math.ceil(math.log(_default_buckets(df), 16)))
    df = df.withColumn("__hk", hash_key(seed, *key_cols))
    bucket = F.conv(F.substring("__hk", 1, prefix_hex), 16, 10).cast("int")
    out = global_index(df, ["__hk"] + list(key_cols), by=by, bucket=bucket,
                       index_col=index_col, total_col=total_col)
    return out.drop("__hk")


# ------------------------------------------------------------------ cut-off keys

DIGITS, FEW = 3, 4096


def _hex64(c: Column) -> Column:
    """16 hex digits that sort as the integer does (its sign bit is flipped)."""
    return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-2 ** 63))), 16, "0")


def text_key(schema: T.StructType, order: list) -> Column | None:
    """A text that sorts as the ``order`` columns do, nulls first; None where a type has no such text."""
    parts = []
    for c in order:
        kind = schema[c].dataType if isinstance(c, str) else None
        if isinstance(kind, T.IntegralType):
            x = _hex64(F.col(c))
        elif isinstance(kind, T.DateType):
            x = _hex64(F.unix_date(c))
        elif isinstance(kind, T.TimestampType):
            x = _hex64(F.unix_micros(F.col(c)))
        elif isinstance(kind, T.StringType):
            x = F.concat(F.hex(F.encode(F.col(c), "UTF-8")), F.lit(" "))  # the blank ends it, before every digit
        else:
            return None
        parts.append(F.coalesce(F.concat(F.lit("1"), x), F.lit("0")))
    return F.concat(*parts)


def _groups(keys: DataFrame, prefix: str) -> list:
    """Counts, least and greatest key by the next ``DIGITS`` characters of the keys that begin with ``prefix``, in order."""
    part = keys.where(F.col("k").startswith(prefix)) if prefix else keys
    found = part.groupBy(F.substring("k", len(prefix) + 1, DIGITS).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    return sorted(found.collect(), key=lambda r: r["g"])


def _key_at(keys: DataFrame, groups: list, rank: int) -> str:
    """The key at position ``rank``: into the one group that holds it, past what all its keys begin with, until few are left."""
    while True:
        for g in groups:
            if rank < g["n"]:
                break
            rank -= g["n"]
        if g["low"] == g["high"]:
            return g["low"]
        prefix = os.path.commonprefix([g["low"], g["high"]])
        if g["n"] <= FEW:
            return sorted(r["k"] for r in keys.where(F.col("k").startswith(prefix) & F.col("k").between(g["low"], g["high"])).collect())[rank]
        groups = _groups(keys, prefix)


def cut_offs(df: DataFrame, key: Column, ranks) -> list[Column]:
    """For each rank that ``ranks(number of rows)`` asks for, the condition that holds for the rows before it.

    Radix selection over a text key of hex digits: the keys alone are written
    once; a round counts them by their next three digits (at most some
    thousand groups, whatever the table) and descends into the group that
    holds the rank; the last ``FEW`` keys are fetched.  A row then compares
    its own key with a constant, so no row moves.  Rows that share a key are
    never parted: a cut-off among them puts them all behind it.
    """
    from retort.session import checkpoint_dir, drop_path, stage_path
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = stage_path(spark, f"cut-{uuid.uuid4().hex}")
    df.select(key.alias("k")).write.parquet(path)
    keys = spark.read.schema("k string").parquet(path)
    groups = _groups(keys, "")
    n = sum(g["n"] for g in groups)
    out = [F.lit(r > 0) if r <= 0 or r >= n else key < F.lit(_key_at(keys, groups, int(r))) for r in ranks(n)]
    drop_path(spark, path)
    return out


def written(df: DataFrame) -> DataFrame:
    """The rows as a table under the shared folder: for a dear plan that is read more than once, such as a corpus to be split."""
    from retort.session import checkpoint_dir, stage_path
    checkpoint_dir(df.sparkSession)
    path = stage_path(df.sparkSession, f"rows-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _first(df: DataFrame, order: list, size) -> Column:
    """The condition that holds for the first ``size(number of rows)`` rows in the order of columns."""
    return cut_offs(df, text_key(df.schema, order), lambda n: [size(n)])[0]


# ------------------------------------------------------------------ splits

def split_train_valid_test(df: DataFrame, key_cols: list, seed: int = 42, frac: float = 0.1,
                           split_col: str = "split") -> DataFrame:
    """Exact sizes: test = int(frac*N), valid = int(frac*N) of the *full* N, rest train (unique keys)."""
    test, valid = cut_offs(df, hash_key(seed, *key_cols), lambda n: [k * math.floor(n * frac) for k in (1, 2)])
    return df.withColumn(split_col, F.when(test, "test").when(valid, "valid").otherwise("train"))


def split_fraction(df: DataFrame, key_cols: list, seed: int = 42, test_size: float = 0.1,
                   split_col: str = "split") -> DataFrame:
    """test = ceil(test_size * N) rows in seeded order, rest train."""
    test, = cut_offs(df, hash_key(seed, *key_cols), lambda n: [math.ceil(n * test_size)])
    return df.withColumn(split_col, F.when(test, "test").otherwise("train"))


def split_head_percent(df: DataFrame, order: list, pct: float = 5.0, split_col: str = "split") -> DataFrame:
    """First round(pct% * N) rows (a half goes to the even number) in row order are validation, the rest train."""
    if text_key(df.schema, order) is not None:
        head = _first(df, order, lambda n: round(n * (pct / 100.0)))
        return df.withColumn(split_col, F.when(head, "validation").otherwise("train"))
    x = global_index(df, order)  # an order whose keys have no text form
    v = F.bround(F.col(TOTAL) * F.lit(pct / 100.0), 0)
    return x.withColumn(split_col, F.when(F.col(IDX) < v, "validation").otherwise("train")).drop(IDX, TOTAL)


def shuffle_rows(df: DataFrame, key_cols: list, seed: int = 42) -> DataFrame:
    """Seeded full shuffle: rows carry ``idx`` = their position in the shuffled order."""
    return hash_index(df, seed, key_cols, total_col=None)


def sample_fraction(df: DataFrame, key_cols: list, frac: float, seed: int = 42) -> DataFrame:
    """Exactly round(frac * N) rows (a half goes to the even number): the first ones in seeded order."""
    return df.where(cut_offs(df, hash_key(seed, *key_cols), lambda n: [round(n * frac)])[0])


def sample_n(df: DataFrame, key_cols: list, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, N) rows: those before the cut-off key of rank n, however large n is."""
    return df.where(cut_offs(df, hash_key(seed, *key_cols), lambda _: [n])[0])


def batch_ids(df: DataFrame, order: list, batch_size: int, drop_last: bool = True,
              seed: int | None = None, key_cols: list | None = None) -> DataFrame:
    """``batch`` = floor(position / batch_size); the short last batch is dropped if asked.

    With ``seed`` the positions come from a seeded shuffle of ``key_cols``.
    """
    x = hash_index(df, seed, key_cols) if seed is not None else global_index(df, order)
    out = x.withColumn("batch", F.floor(F.col(IDX) / batch_size))
    if drop_last:
        out = out.where(F.col(IDX) < F.floor(F.col(TOTAL) / batch_size) * batch_size)
    return out.drop(TOTAL)


def stratified_folds(df: DataFrame, label: str, order: list, k: int = 10, fold_col: str = "fold") -> DataFrame:
    """Unshuffled stratified k folds (the block allocation of a stratified k-fold).

    Classes are numbered by first appearance; class c occupies sorted
    positions [s, s+n); fold i receives #{p in [s, s+n): p mod k = i} rows
    of class c, handed out as contiguous blocks in row order.  The class
    table (one row per label value) is tiny; rows get their within-class
    position from ``global_index`` (a hot class spreads over buckets).
    """
    first_key = order[0]
    x = global_index(df, order, by=[label], index_col="__j", total_col="__nc")
    classes = x.groupBy(label).agg(F.min(first_key).alias("__first"), F.first("__nc").alias("__nc"))
    wc = Window.orderBy("__first")  # one row per class: bounded by the label cardinality
    classes = classes.select(
        label, "__nc", F.coalesce(F.sum("__nc").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    s, n = F.col("__s"), F.col("__nc")
    # fold i gets ceil((s+n-i)/k) - ceil((s-i)/k) rows of the class; running sums are its blocks' ends
    ends, end = [], F.lit(0).cast("long")
    for i in range(k):
        end = end + F.floor((s + n - i + (k - 1)) / k) - F.floor((s - i + (k - 1)) / k)
        ends.append(end)
    bounds = classes.select(label, F.array(*ends).alias("__ends"))
    y = x.join(bounds, label)  # no hint: the class table is broadcast only when it is small at run time
    fold = F.size(F.filter(F.transform("__ends", lambda e: F.col("__j") - e), lambda d: d >= 0))
    return y.withColumn(fold_col, fold.cast("int")).drop("__j", "__nc", "__ends")


def oversample_minority(df: DataFrame, label: str, minority, k: int, key_cols: list,
                        seed: int = 42) -> DataFrame:
    """Append n_min * k draws with replacement from the minority class.

    Draw d (0 <= d < n_min*k) takes minority row number md5(seed|d) mod
    n_min.  Draws are generated distributedly from ``range`` and matched to
    the indexed minority rows by an equi-join, so the output has exactly
    N + k * n_min rows.
    """
    spark = df.sparkSession
    mino = global_index(df.where(F.col(label) == F.lit(minority)), list(key_cols), index_col="__mi",
                        total_col=None)
    n_min = df.where(F.col(label) == F.lit(minority)).count()
    if n_min == 0:
        return df
    draws = spark.range(0, n_min * k).select(
        (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10)
         .cast("bigint") % F.lit(n_min)).alias("__mi"))
    extra = draws.join(mino, "__mi").drop("__mi")
    return df.unionByName(extra.select(*df.columns))


def head_slice(df: DataFrame, order: list, n: int | None = None, frac: float | None = None) -> DataFrame:
    """The first n rows in row order, or the first floor(frac * N): those before a cut-off key, so no row moves."""
    size = (lambda _: n) if n is not None else (lambda total: math.floor(total * frac))
    if text_key(df.schema, order) is not None:
        return df.where(_first(df, order, size))
    x = global_index(df, order)  # an order whose keys have no text form
    most = F.floor(F.col(TOTAL) * F.lit(frac)) if n is None else F.lit(n)
    return x.where(F.col(IDX) < most).drop(IDX, TOTAL)


def running_sum(df: DataFrame, order: list, value, by: list | None = None, out=None,
                inclusive: bool = True, buckets: int | None = None) -> DataFrame:
    """Running sum(s) of ``value`` (a name or list of names) in ``order`` within ``by``.

    Bucketed like global_index: range buckets -> per-bucket sums -> bucket
    offsets (small table) -> window sum inside each bucket + offset.  No
    task sees more than one bucket of rows, however large a group is.
    ``out`` defaults to ``cum_<value>``.
    """
    by = list(by or [])
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else (out or [f"cum_{v}" for v in values])
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    nb = buckets or _default_buckets(df)
    b = _range_buckets(df, nb, [F.col(c) for c in by] + order_cols)
    sums = b.groupBy(*by, "__b").agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(values)])
    wb = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(*by, "__b", *[F.coalesce(F.sum(f"__s{i}").over(wb), F.lit(0)).alias(f"__o{i}")
                                     for i in range(len(values))])
    j = b.join(offs, on=by + ["__b"], how="inner")
    frame = (Window.partitionBy(*by, "__b").orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    for i, (v, o) in enumerate(zip(values, outs)):
        j = j.withColumn(o, F.coalesce(F.sum(v).over(frame), F.lit(0)) + F.col(f"__o{i}"))
    return j.drop("__b", *[f"__o{i}" for i in range(len(values))])
