"""Minimum-cost-flow resharding.

Given the sizes of the old shards and the capacities of the new ones, a
minimum-cost flow (successive shortest paths on the small graph of old
against new shards; a byte that stays in its shard costs nothing, a moved
byte one) says how many bytes go from where to where.  Every old shard is a
sequence of blocks of documents; the flow out of it cuts that sequence into
consecutive ranges, so whole blocks move and only a block that a cut passes
through is split between two documents.  Only shards that gain or lose
documents are rewritten.

The driver solves a graph of (old shards x new shards) edges and sees nothing
that grows with the data.  Blocks are hash buckets of about
``DOCS_PER_BLOCK`` documents inside an old shard, so the largest source is
spread over many; positions come from running sums over the block table plus
running sums inside each block.  Blocks hold documents of one size class,
large ones first, so cuts fall among small documents and sizes come out equal.

Defined results: size is the UTF-8 bytes of the text plus 1, a null text has
none, so 1; repeated rows are placed one by one; a null doc_id is placed like
any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW_SHARDS = 16
DOCS_PER_BLOCK = 2_000


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow of all supply into the demand (their sums must agree), by shortest augmenting paths."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    left, room, flow = list(supply), list(demand), {}
    n, m = len(supply), len(demand)
    while any(left):
        # Bellman-Ford over the residual graph: old shard i -> new shard j at cost, back along used edges
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    c = cost(i, j)
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + c < dist[n + j]):
                        dist[n + j], came[n + j], changed = dist[i] + c, i, True
                    if flow.get((i, j)) and dist[n + j] is not None and (dist[i] is None or dist[n + j] - c < dist[i]):
                        dist[i], came[i], changed = dist[n + j] - c, n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if room[j] and dist[n + j] is not None), key=lambda j: (dist[n + j], j))
        path, at = [n + end], n + end
        while came[at] is not None:
            at = came[at]
            path.append(at)
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0]], room[end]] + [flow[(b, a - n)] for a, b in steps if a >= n])
        for a, b in steps:
            key, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """doc_id, size, text_crc32 and the old shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))


def plan(rows: DataFrame, capacities: list[int] | None = None, new_shards: int = NEW_SHARDS):
    """(flow, documents): the transfers in bytes by (old, new), and the number of documents."""
    sums = {r["old_shard"]: (r["b"], r["n"]) for r in
            rows.groupBy("old_shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    old = sorted(sums)
    supply = [sums[s][0] for s in old]
    demand = capacities or equal_capacities(sum(supply), new_shards)
    flow = min_cost_flow(supply, demand, lambda i, j: 0 if old[i] == j else 1)
    return {(old[i], j): v for (i, j), v in flow.items()}, sum(n for _, n in sums.values())


def place(rows: DataFrame, flow: dict[tuple[int, int], int], documents: int) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``moved``.

    The bytes that stay come first in an old shard, then each transfer.  A
    document goes to the shard in whose range its middle byte lies.
    """
    if not documents:
        return rows.selectExpr("*", "0L AS block", "0 AS shard", "0L AS slot", "false AS moved")
    blocks = max(1, -(-documents // DOCS_PER_BLOCK))
    size_class = F.length(F.bin("size"))
    order = [F.xxhash64("doc_id", "text_crc32"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    r = rows.withColumn("block", 
                     (64 - size_class) * F.lit(blocks).cast("long") + F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(blocks)))
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (r.groupBy("old_shard", "block").agg(F.sum("size").alias("b"))
              .select("old_shard", "block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("block_start")))
    inside = Window.partitionBy("old_shard", "block").orderBy(*order)
    earlier = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = (r.withColumns({"in_block": earlier, "at": F.row_number().over(inside)})
         .join(starts, ["old_shard", "block"]).withColumn("middle", 
                 F.col("block_start") + F.col("in_block") + F.floor(F.col("size") / 2)))
    shard = F.lit(None).cast("int")
    for s in sorted({s for s, _ in flow}):
        targets = sorted((j for o, j in flow if o == s), key=lambda j: (j != s, j))
        cut, choice = 0, F.lit(targets[-1])
        cuts = []
        for j in targets[:-1]:
            cut += flow[(s, j)]
            cuts.append((cut, j))
        for c, j in reversed(cuts):
            choice = F.when(F.col("middle") < F.lit(c), F.lit(j)).otherwise(choice)
        shard = F.when(F.col("old_shard") == s, choice).otherwise(shard)
    r = r.withColumn("shard", shard.cast("int"))
    group = ["shard", "old_shard", "block"]
    counts = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at0"))
    in_shard = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "at0", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("slot0"))
    return (r.join(offsets, group)  # a shard's share of a block is consecutive, so its places are too
            .withColumn("slot", F.col("slot0") + F.col("at") - F.col("at0"))
            .withColumn("moved", F.col("shard") != F.col("old_shard"))
            .select(*rows.columns, "block", "shard", "slot", "moved"))


def reshard(docs: DataFrame, old_shard: Column, capacities: list[int] | None = None,
            new_shards: int = NEW_SHARDS) -> DataFrame:
    rows = sized(docs, old_shard)
    return place(rows, *plan(rows, capacities, new_shards))


def affected(flow: dict[tuple[int, int], int]) -> list[int]:
    """Shards whose files change: those that lose or gain documents."""
    return sorted({x for (o, j) in flow if o != j for x in (o, j)})


def rewrite(docs: DataFrame, placed: DataFrame, changed: list[int], path: str, id_column: str = "doc_id") -> None:
    """Write the files of the changed shards, ``path/shard=N``; other shards' folders stay as they are.

    ``docs`` has one row per id.  Rows are dealt by shard and slot range, so a shard is written by many tasks.
    """
    where = placed.where(F.col("shard").isin(changed)).select(F.col(id_column).alias("__id"), "shard", "slot")
    out = docs.join(where, F.col(id_column).eqNullSafe(F.col("__id"))).drop("__id")
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path))
