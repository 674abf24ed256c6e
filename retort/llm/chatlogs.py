"""Chat formatting: collapse cumulative snapshots, then render.

A service that logs the whole conversation after every turn leaves many
conversations that are beginnings of longer ones.  Every turn gets the
rolling hash of its turn prefix; a conversation is dropped when its full
hash is the hash of a shorter prefix of another one (an anti-join), and of
equal conversations the smallest conv_id stays.  What is left is rendered.

Prefix hashes are running sums of 128 hash bits of (position, role, text).
Sums, not a fold, let a very long conversation be split: turns are dealt to
segments of ``SEGMENT`` turn numbers, and each segment starts from the sums
of those before it.  Built-in functions only.

Defined results: turns are ordered by (turn, role, text), nulls first, so
repeated turns count as turns; a null role renders as ``DEFAULT_ROLE``, a
null text as empty; null and empty texts are the same turn; rows without
conv_id form one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.session import checkpoint_dir

SEGMENT = 1024
DEFAULT_ROLE = "user"
_HEAD, _TAIL = "<|im_start|>", "<|im_end|>\n"
_PARTS = ["__h0", "__h1", "__h2", "__h3"]


def turns(chats: DataFrame) -> DataFrame:
    """conv_id, segment, turn, role and text; nothing else of the input."""
    t = F.col("turn").cast("long")
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), t.alias("turn"),
                        F.coalesce(F.floor(t / SEGMENT), F.lit(-(1 << 60))).alias("segment"),
                        F.coalesce(F.col("role"), F.lit(DEFAULT_ROLE)).alias("role"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _running(df: DataFrame, values: list[str], inside: list) -> DataFrame:
    """Inclusive running sums of ``values`` over a conversation: inside a segment, plus all earlier segments."""
    sums = df.groupBy("conv_id", "segment").agg(*[F.sum(v).alias(f"{v}_s") for v in values])
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("conv_id").alias("__c"), F.col("segment").alias("__g"),
                         *[F.coalesce(F.sum(f"{v}_s").over(before), F.lit(0)).alias(f"{v}_b") for v in values])
    own = Window.partitionBy("conv_id", "segment").orderBy(*inside).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(starts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("segment") == F.col("__g")))
    return (joined.withColumns({v: F.sum(v).over(own) + F.col(f"{v}_b") for v in values})
            .drop("__c", "__g", *[f"{v}_b" for v in values]))


def prefixes(chats: DataFrame) -> DataFrame:
    """One narrow row per turn: conv_id, length (turns so far) and the hash of that prefix."""
    t = turns(chats).select("conv_id", "segment", "turn", F.xxhash64("role", "text").alias("a"),
                            F.xxhash64(F.lit(7), "text", F.lit(1), "role").alias("b"))
    order = ["turn", "a", "b"]
    t = _running(t.withColumn("length", F.lit(1).cast("long")), ["length"], order)
    low, high = F.lit((1 << 32) - 1), 32
    x, y = F.xxhash64("length", "a", "b"), F.xxhash64("b", "length", "a")
    parts = {"__h0": x.bitwiseAND(low), "__h1": F.shiftrightunsigned(x, high),
             "__h2": y.bitwiseAND(low), "__h3": F.shiftrightunsigned(y, high)}
    t = _running(t.withColumns(parts), _PARTS, ["length"])
    return t.select("conv_id", "length", F.struct(*_PARTS).alias("prefix"))


def maximal(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that begin no longer one; one of equal ones."""
    checkpoint_dir(chats.sparkSession)
    p = prefixes(chats).checkpoint()  # narrow rows, read three times below
    ends = p.groupBy("conv_id").agg(F.max(F.struct("length", "prefix")).alias("w"))
    full = (ends.select("conv_id", "w.length", "w.prefix").groupBy("length", "prefix")
            .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    size = ends.select(F.col("conv_id").alias("__c"), F.col("w.length").alias("n_turns"))
    inner = (p.join(size, F.col("conv_id").eqNullSafe(F.col("__c")))
             .where(F.col("length") < F.col("n_turns")).select("length", "prefix").distinct())
    return (full.join(inner, ["length", "prefix"], "left_anti")
            .select("conv_id", F.col("length").alias("n_turns"), "n_copies"))


def render(chats: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations as one text each, turn after turn between role markers."""
    t = turns(chats)
    k = kept.withColumnRenamed("conv_id", "__c")
    line = F.struct(F.col("turn"), F.xxhash64("role", "text").alias("a"),
                    F.xxhash64(F.lit(7), "text", F.lit(1), "role").alias("b"),
                    F.concat(F.lit(_HEAD), "role", F.lit("\n"), "text", F.lit(_TAIL)).alias("line"))
    own = t.join(k, F.col("conv_id").eqNullSafe(F.col("__c"))).select(*t.columns, "n_turns", "n_copies")
    return (own.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(line)).alias("lines"))
            .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered")))


def collapse(chats: DataFrame) -> DataFrame:
    return render(chats, maximal(chats))
