"""Vector codes: product quantisation trained by dual-tree Lloyd rounds, in integers.

A vector's components become integers floor(4096 * x) and are cut into
consecutive parts; every part position has a codebook of its own.  Vectors
are gathered once into blocks of ``BLOCK``; for every part position a block
keeps its points in the order of a balanced tree (halved at the median of the
widest side) with the bounding box and the sum of every node.  The blocks are
written to the shared folder and read again by each round.

A round walks two trees at once: the block's over its points and one over the
codebook's entries.  Of a node pair the boxes bound the distances from below
and above; entries that are farther than another entry for every point of the
node fall away.  A node with one entry left is assigned as a whole, by its
stored sum; the points of leaves that stay uncertain are compared one by one.
All of it is integer arithmetic, so results do not depend on the order of
rows, blocks or tasks.  A round sends (parts x entries x width) sums through
one aggregate to the driver, whatever the number of vectors.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped, and so are vectors shorter than the longest kept one
(they lack components); an empty table gives an empty result; repeated rows
count once each, and seeds with equal vec_id are taken in the order of their
components; a null vec_id is coded like any other but never a seed, unless
there are too few others; fewer kept vectors than entries give a codebook of
that many entries; a width that the number of parts does not divide gives the
first parts one component more; other columns are ignored.  Components so
large that a squared distance would leave 64 bits raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retort.session import checkpoint_dir, drop_path, stage_path

PARTS, ENTRIES, ROUNDS, UNIT = 8, 16, 6, 4096
BLOCK, LEAF = 4096, 32


# ------------------------------------------------------------------ trees

def _starts(n: int, level: int) -> np.ndarray:
    """First points of the 2**level nodes of a level over n points, and n."""
    return (n * np.arange(2 ** level + 1)) >> level


def tree_order(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, int]:
    """(order of the points, levels below the root): each level halves its nodes along their widest side."""
    n, width = points.shape
    depth = max(0, (n // leaf).bit_length() - 1) if width else 0
    order = np.arange(n)
    for level in range(depth):
        at = _starts(n, level)
        p = points[order]
        side = (np.maximum.reduceat(p, at[:-1]) - np.minimum.reduceat(p, at[:-1])).argmax(1)
        node = np.repeat(np.arange(2 ** level), np.diff(at))
        order = order[np.lexsort((p[np.arange(n), side[node]], node))]
    return order, depth


def node_tables(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest corner and sum of every node, level by level from the root."""
    out = []
    for level in range(depth + 1):
        at = _starts(len(points), level)[:-1]
        out.append([f.reduceat(points, at) for f in (np.minimum, np.maximum, np.add)])
    return tuple(np.concatenate(x) for x in zip(*out))


class EntryTree:
    """A tree over a codebook; its last level holds single entries."""

    def __init__(self, codebook: np.ndarray):
        self.entries = codebook
        order, depth = tree_order(codebook, 1)
        low, high, _ = node_tables(codebook[order], depth)
        self.levels, k = [], len(codebook)
        for level in range(depth + 1):
            node = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            # where the columns of the next level come from
            parent = np.arange(2 ** level) // 2
            self.levels.append((parent, low[node], high[node]))
        leaf = np.repeat(np.arange(2 ** depth), np.diff(_starts(k, depth)))
        back = np.argsort(order)  # single entries stand in the order of their index
        self.levels.append((leaf[back], codebook, codebook))


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, depth: int, entries: EntryTree):
    """(entry of every point, sums and counts by entry, points compared one by one) of one part of a block."""
    n, k, last = len(points), len(entries.entries), len(entries.levels) - 1
    book = entries.entries
    owner = np.zeros(n, np.int64)
    total, count, compared = np.zeros_like(book), np.zeros(k, np.int64), 0
    square = (book * book).sum(1)
    level, step, fresh = 0, 0, False
    nodes, alive = np.zeros(1, np.int64), np.ones((1, 1), bool)
    while len(nodes):
        parent, e_low, e_high = entries.levels[step]
        if fresh:  # the columns of the step before become those of this one
            alive = alive[:, parent]
        fresh = False
        q_low, q_high = low[2 ** level - 1 + nodes][:, None], high[2 ** level - 1 + nodes][:, None]
        gap = np.maximum(np.maximum(q_low - e_high, e_low - q_high), 0)
        reach = np.maximum(q_high - e_low, e_high - q_low)
        least, most = (gap * gap).sum(2), (reach * reach).sum(2)
        alive = alive & (least <= np.where(alive, most, np.iinfo(np.int64).max).min(1, keepdims=True))
        at = _starts(n, level)
        if step == last:
            # entry j goes where the entry nearest to the middle beats it at every corner of the box
            best = np.where(alive, least + most, np.iinfo(np.int64).max).argmin(1)
            turn = book[best][:, None] - book[None]
            worst = (square[best][:, None] - square[None]
                     - 2 * np.minimum(turn * q_low, turn * q_high).sum(2))
            index = np.arange(k)
            alive &= (worst > 0) | ((worst == 0) & (index[None] < best[:, None])) | (index[None] == best[:, None])
            sure = alive.sum(1) == 1
            if sure.any():
                whole, to = nodes[sure], alive[sure].argmax(1)
                np.add.at(total, to, sums[2 ** level - 1 + whole])
                np.add.at(count, to, at[whole + 1] - at[whole])
                for a, b, e in zip(at[whole].tolist(), at[whole + 1].tolist(), to.tolist()):
                    owner[a:b] = e
            nodes, alive = nodes[~sure], alive[~sure]
            if level == depth and len(nodes):
                size = at[nodes + 1] - at[nodes]
                which = np.repeat(np.arange(len(nodes)), size)
                place = np.arange(len(which)) + np.repeat(at[nodes] - np.cumsum(size) + size, size)
                p = points[place]
                d = ((p[:, None] - book[None]) ** 2).sum(2)
                e = np.where(alive[which], d, np.iinfo(np.int64).max).argmin(1)
                owner[place] = e
                np.add.at(total, e, p)
                np.add.at(count, e, 1)
                compared += len(p)
                break
        else:
            step, fresh = step + 1, True
            if level == depth:
                continue
        nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
        alive = np.repeat(alive, 2, axis=0)
        level += 1
    return owner, total, count, compared


# ------------------------------------------------------------------ blocks

def _integers(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * UNIT).astype(np.int64).reshape(len(column), width)


def _cuts(width: int, parts: int) -> list[int]:
    return np.append(0, np.cumsum([width // parts + (p < width % parts) for p in range(parts)])).tolist()


def _block(rows: pa.Table, cuts: list[int], schema: pa.Schema) -> pa.RecordBatch:
    v = _integers(rows.column("embedding").combine_chunks(), cuts[-1])
    order, points, nodes = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        o, depth = tree_order(v[:, a:b])
        p = v[o, a:b]
        low, high, sums = node_tables(p, depth)
        order.append(o.astype("<u4").tobytes())
        points.append(p.astype("<i4").tobytes())
        nodes.append(low.astype("<i4").tobytes() + high.astype("<i4").tobytes() + sums.astype("<i8").tobytes())
    values = [[rows.column("vec_id").to_pylist()], [rows.column("label").to_pylist()], [order], [points], [nodes]]
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(values, schema)], schema=schema)


def _parts(batch: pa.RecordBatch, row: int, cuts: list[int]):
    """(order, points, lows, highs, sums, depth) of every part of a block."""
    order, points, nodes = (batch.column(c)[row].as_py() for c in ("order", "points", "nodes"))
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        w = b - a
        o = np.frombuffer(order[p], "<u4").astype(np.int64)
        v = np.frombuffer(points[p], "<i4").astype(np.int64).reshape(len(o), w)
        m = len(nodes[p]) // (16 * w) if w else 1
        box = np.frombuffer(nodes[p], "<i4", 2 * m * w).astype(np.int64).reshape(2, m, w)
        sums = np.frombuffer(nodes[p], "<i8", m * w, 8 * m * w).reshape(m, w)
        yield o, v, box[0], box[1], sums, (m + 1).bit_length() - 2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows with only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    return rows.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))


def write_blocks(rows: DataFrame, cuts: list[int], path: str) -> DataFrame:
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())),
                           T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
                           *[T.StructField(c, T.ArrayType(T.BinaryType())) for c in ("order", "points", "nodes")]])

    def gather(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)
        held, size = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, BLOCK - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == BLOCK:
                    yield _block(pa.Table.from_batches(held), cuts, out)
                    held, size = [], 0
        if size:
            yield _block(pa.Table.from_batches(held), cuts, out)

    rows.mapInArrow(gather, schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


# ------------------------------------------------------------------ rounds

def round_sums(blocks: DataFrame, codebooks: list[np.ndarray], cuts: list[int]) -> DataFrame:
    """(part, entry, pos, value): sums of the assigned points by component, and their count at position -1."""
    def run(batches):
        trees: list = []
        total, count = [np.zeros_like(c) for c in codebooks], [np.zeros(len(c), np.int64) for c in codebooks]
        for b in batches:
            for row in range(b.num_rows):
                trees = trees or [EntryTree(c) for c in codebooks]
                for p, (_, points, low, high, sums, depth) in enumerate(_parts(b, row, cuts)):
                    _, t, c, _ = nearest(points, low, high, sums, depth, trees[p])
                    total[p] += t
                    count[p] += c
        if trees:
            rows = [(p, e, i, int(v)) for p in range(len(total)) for e in range(len(count[p]))
                    for i, v in enumerate([count[p][e], *total[p][e]], -1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "pos", "value"])

    return (blocks.mapInArrow(run, "part int, entry int, pos int, value long")
            .groupBy("part", "entry", "pos").agg(F.sum("value").alias("value")))


def moved(codebooks: list[np.ndarray], sums) -> list[np.ndarray]:
    """Every entry at floor(sum / count) of its points; unused entries stay."""
    by = {(r["part"], r["entry"], r["pos"]): r["value"] for r in sums}
    out = [c.copy() for c in codebooks]
    for p, book in enumerate(out):
        for e in range(len(book)):
            n = by.get((p, e, -1), 0)
            if n:
                book[e] = [by[p, e, i] // n for i in range(book.shape[1])]
    return out


def assign(blocks: DataFrame, codebooks: list[np.ndarray], cuts: list[int], label_type: T.DataType) -> DataFrame:
    """vec_id, label, code and error of every vector of the blocks."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out, trees = to_arrow_schema(schema), []
        for b in batches:
            for row in range(b.num_rows):
                trees = trees or [EntryTree(c) for c in codebooks]
                ids, labels = b.column("ids")[row].values, b.column("labels")[row].values
                codes, error = np.zeros((len(ids), len(codebooks)), np.uint8), np.zeros(len(ids), np.int64)
                for p, (order, points, low, high, sums, depth) in enumerate(_parts(b, row, cuts)):
                    owner = nearest(points, low, high, sums, depth, trees[p])[0]
                    codes[order, p] = owner
                    error[order] += ((points - codebooks[p][owner]) ** 2).sum(1)
                digits, width = codes.tobytes().hex(), 2 * len(codebooks)
                text = [digits[i:i + width] for i in range(0, len(digits), width)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], schema=out)

    return blocks.mapInArrow(run, schema)


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for c in codebooks for v in c.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(codes, codebooks): vec_id, label, code, error and label_error of every kept vector, and the trained entries.

    ``label_error`` is the error summed over equal labels (nulls together).
    The sums by label are written before the join, so a label that holds most
    rows is summed in the tasks that read it and its join can be split.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code byte holds 1 to 256 entries")
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    rows = usable(vectors)
    label_type = rows.schema["label"].dataType
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double")))
    width, top = rows.agg(F.max(F.size("embedding")), F.max(largest)).first()
    width, top = width or 0, top or 0.0
    if width * (2 * (UNIT * top + 1)) ** 2 >= 2 ** 62:
        raise ValueError("components are too large for 64-bit distances: scale the vectors first")
    rows, cuts = rows.where(F.size("embedding") == width), _cuts(width, parts)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    seeds = _integers(pa.array([r["embedding"] for r in seeds], pa.list_(pa.float64())), width)
    codebooks = [seeds[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    folder = stage_path(spark, f"vectorcodes-{uuid.uuid4().hex}")
    blocks = write_blocks(rows, cuts, folder)
    if len(seeds):
        for _ in range(rounds):
            codebooks = moved(codebooks, round_sums(blocks, codebooks, cuts).collect())
    codes = assign(blocks, codebooks, cuts, label_type).checkpoint()
    drop_path(spark, folder)
    by_label = (codes.groupBy("label").agg(F.sum("error").alias("label_error"))
                .withColumnRenamed("label", "__label").checkpoint())
    codes = codes.join(by_label, codes["label"].eqNullSafe(by_label["__label"])).drop("__label")
    return codes, codebooks
