"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles.  A set of coordinates (min-hashes of the
set: two sets agree on one with probability equal to their similarity) stands
for the tokens that a chosen path samples.  Each run splits all sets on the
value of one coordinate; buckets above ``BUCKET`` sets are split again on a
coordinate drawn from the path so far, ``DEPTH`` times at most; small buckets
are compared by brute force.  A pair of similarity ``threshold`` stays together
through a run with probability of at least ``threshold ** DEPTH``, and runs
are repeated until a pair is missed with probability ``1 - TARGET_RECALL``.
Whatever is still large after the last split is compared tile against tile,
so no task gets more than two tiles and nothing is dropped.

A pair belongs to the first run in which its two sets share a bucket, which
both sets' bucket lists show; so a pair counts once without any list of
pairs.  Pairs that the coordinates rule out are passed over; all others are
verified on their whole sets of shingle hashes.

Equal texts are one class from the start: they are reduced map-side, and
copies are never expanded into pairs.

Results (``linked``): one row per input row with ``class_id``, the smallest
doc_id of its group of linked texts, ``n_copies`` of its text, and ``n_links``,
the number of other texts it is linked to.

Defined results: a text of one to four words is one shingle; a null text is
empty; equal empty texts are copies of each other and link to nothing else;
rows without doc_id take part, and a group without any doc_id has class_id
null; repeated rows are copies; an empty table gives an empty result; other
columns are ignored by ``linked`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm import textscan as ts
from retort.llm.common import session_size, text_key, texts
from retort.session import checkpoint_dir

SHINGLE, THRESHOLD = 5, 0.8
TARGET_RECALL = 0.999_999
DEPTH, BUCKET, TILE = 3, 500, 500
COORDS = 64
RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - THRESHOLD ** DEPTH))  # 20
MIN_AGREE = COORDS // 2  # a pair of similarity 0.8 agrees on fewer with probability 1e-8
_LOW = ts.U((1 << 52) - 1)
_rng = np.random.default_rng(20_240_607)
_FLIP = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * ts.U(2) + ts.U(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE):
    """(hash, row) of the distinct shingles of each text, sorted; at most 4096 texts."""
    _, _, rows, h = ts.words(buf, off)
    count = np.bincount(rows, minlength=len(off) - 1)
    parts = []
    for n in range(1, size + 1):
        own = count[rows] == n if n < size else count[rows] >= size
        if own.any():
            g, at = ts.ngrams(h[own], rows[own], n)
            parts.append((rows[own][at].astype(ts.U) << ts.U(52)) | (g >> ts.U(12)))
    key = np.unique(np.concatenate(parts)) if parts else np.zeros(0, ts.U)
    return key & _LOW, (key >> ts.U(52)).astype(np.int64)


def coordinates(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """An n x COORDS array of 32-bit min-hashes; rows without shingles are zero."""
    out = np.zeros((n, COORDS), "<u4")
    if len(h):
        has, first = np.unique(rows, return_index=True)
        x = ts.mix(h)
        for i in range(COORDS):
            out[has, i] = np.minimum.reduceat((x ^ _FLIP[i]) * _TIMES[i], first) >> ts.U(32)
    return out


def _text_slices(column):
    buf, off = ts.text_bytes(column)
    for lo, hi in ts.slices(off):
        for a in range(lo, hi, 4096):
            b = min(hi, a + 4096)
            yield a, b, buf[off[a]:off[b]], off[a:b + 1] - off[a]


def _binary(rows: np.ndarray) -> pa.Array:
    """A fixed-width array, one row each, as a binary column."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _matrix(column, dtype, width: int) -> np.ndarray:
    """The other way round."""
    buf, _ = ts.text_bytes(column)
    return buf.view(dtype).reshape(-1, width) if len(buf) else np.zeros((0, width), dtype)


def classes(docs: DataFrame) -> DataFrame:
    """One row per different text: key, rep (smallest doc_id), n_copies, size (shingles) and coords."""
    def run(batches):
        for batch in batches:
            size, coords = [], []
            for a, b, buf, off in _text_slices(batch.column(1)):
                h, rows = shingle_sets(buf, off)
                size.append(np.bincount(rows, minlength=b - a))
                coords.append(coordinates(h, rows, b - a))
            if size:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(np.concatenate(size).astype(np.int32)),
                     _binary(np.concatenate(coords))], names=["doc_id", "key", "size", "coords"])

    rows = (texts(docs).withColumn("key", text_key(F.col("text")))
            .mapInArrow(run, "doc_id long, key binary, size int, coords binary"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"),
                                   F.any_value("size").alias("size"), F.any_value("coords").alias("coords"))


def _coordinate(coords, i):
    return F.substring(coords, i * 4 + 1, 4)


def buckets(sets: DataFrame) -> DataFrame:
    """Leaves of all runs: key, run, path and n (sets in it); leaves of one set are left out."""
    has = sets.where("size > 0")
    rows = has.select("key", F.posexplode(F.array(*[_coordinate(F.col("coords"), F.lit(r)) for r in range(RUNS)]))
                      .alias("run", "value")).select("key", "run", F.xxhash64("run", "value").alias("path"))
    pool = (COORDS - RUNS) // (DEPTH - 1)
    leaves = []
    for level in range(1, DEPTH + 1):
        n = rows.groupBy("run", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        n = n.checkpoint()  # written, so that Spark can split the join's hot buckets
        full = rows.join(n, ["run", "path"]).checkpoint()
        last = level == DEPTH
        leaves.append(full if last else full.where(F.col("n") <= BUCKET))
        large = full.where(F.col("n") > BUCKET)
        if last or large.isEmpty():
            break
        drawn = F.lit(RUNS + (level - 1) * pool) + F.pmod(F.xxhash64("path", F.lit(level)), F.lit(pool))
        rows = (large.join(has.select("key", "coords"), "key")
                .select("key", "run", F.xxhash64("path", _coordinate(F.col("coords"), drawn.cast("int"))).alias("path")))
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out


def _members(sets: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per set and bucket or pair of tiles, with all that pair rules need."""
    lists = leaves.groupBy("key").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("run") == r, F.col("path"))), F.lit(0)) for r in range(RUNS)]).alias("leaves"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("key"), tiles).cast("int")
    other = F.when(F.col("n") > BUCKET, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.lit(-1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    placed = (leaves.withColumn("tile", F.when(F.col("n") > BUCKET, tile).otherwise(F.lit(-1)))
              .withColumn("other", F.explode(other))
              .select("key", "run", F.col("path").alias("leaf"), "tile", (low != high).alias("across"),
                      F.xxhash64("run", "path", low, high).alias("path")))
    low_bytes = F.concat(*[F.substring("coords", i * 4 + 1, 1) for i in range(COORDS)])
    about = (lists.join(sets.select("key", "size", low_bytes.alias("marks")), "key"))
    return placed.join(about, "key").select("path", "key", "run", "tile", "across", "size", "leaves", "marks")


_MEMBER_SCHEMA = ("path long, key binary, run int, tile int, across boolean, size int, leaves array<long>, marks binary")


def _whole_groups(batches):
    """Tables that hold whole path groups; the input is sorted by path."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if kept is not None:
            t = pa.concat_tables([kept, t])
        path = t.column(0).combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(path != path[-1])[-1]) + 1 if path[0] != path[-1] else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        kept = t.slice(cut)
    if kept is not None:
        yield kept.combine_chunks()


class _Group:
    """Numpy views of the member columns of a table of whole groups."""

    def __init__(self, t: pa.Table):
        num = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        self.path, self.run, self.tile, self.size = num("path"), num("run"), num("tile"), num("size")
        self.across = num("across")
        lists = t.column("leaves").combine_chunks()
        self.leaves = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, RUNS)
        self.marks = _matrix(t.column("marks").combine_chunks(), np.uint8, COORDS)
        new = np.flatnonzero(np.append(True, self.path[1:] != self.path[:-1]))
        self.groups = list(zip(new, np.append(new[1:], len(self.path))))

    def candidates(self, s: int, e: int):
        """Pairs (i < j) of the group that belong to it and that the coordinates do not rule out."""
        run = self.run[s]
        size = self.size[s:e]
        ok = np.minimum.outer(size, size) >= THRESHOLD * np.maximum.outer(size, size)
        ok &= np.tri(e - s, k=-1, dtype=bool).T
        if self.across[s]:
            ok &= self.tile[s:e, None] != self.tile[None, s:e]
        for r in range(run):
            leaf = self.leaves[s:e, r]
            ok &= (leaf[:, None] != leaf[None, :]) | (leaf == 0)[:, None]
        i, j = np.nonzero(ok)
        if len(i):
            agree = np.zeros(len(i), np.int64)
            for a in range(0, len(i), 1 << 16):
                agree[a:a + (1 << 16)] = (self.marks[s + i[a:a + (1 << 16)]] == self.marks[s + j[a:a + (1 << 16)]]).sum(1)
            i, j = i[agree >= MIN_AGREE], j[agree >= MIN_AGREE]
        return i, j


def _active(batches):
    """The members that have a candidate in their bucket."""
    for t in _whole_groups(batches):
        g = _Group(t)
        keep = np.zeros(t.num_rows, bool)
        two = np.array([s for s, e in g.groups if e - s == 2], np.int64)
        if len(two):  # most buckets: all of them at once
            a, b = two, two + 1
            ok = np.minimum(g.size[a], g.size[b]) >= THRESHOLD * np.maximum(g.size[a], g.size[b])
            ok &= ~(g.across[a] & (g.tile[a] == g.tile[b]))
            met = (g.leaves[a] == g.leaves[b]) & (g.leaves[a] != 0) & (np.arange(RUNS) < g.run[a][:, None])
            ok &= ~met.any(1) & ((g.marks[a] == g.marks[b]).sum(1) >= MIN_AGREE)
            keep[a[ok]] = keep[b[ok]] = True
        for s, e in g.groups:
            if e - s > 2:
                i, j = g.candidates(s, e)
                keep[s + i] = keep[s + j] = True
        if keep.any():
            yield from t.filter(pa.array(keep)).to_batches()


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted sets i and j."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    row, col = row[shared[col]], number[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, (c, c + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[a:b], col[a:b] - c] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def _verify(batches):
    """Links of each member in its bucket, and the smallest key of its part of the bucket."""
    for t in _whole_groups(batches):
        g = _Group(t)
        keys = t.column("key").combine_chunks().to_pylist()
        buf, off = ts.text_bytes(t.column("shingles").combine_chunks())
        hashes, off = buf.view(np.uint64), off // 8
        out = []
        for s, e in g.groups:
            i, j = g.candidates(s, e)
            if not len(i):
                continue
            sets = [hashes[off[k]:off[k + 1]] for k in range(s, e)]
            common = _overlaps(sets, i, j)
            size = g.size[s:e]
            good = common >= THRESHOLD * (size[i] + size[j] - common) - 1e-9
            i, j = i[good], j[good]
            links = np.bincount(np.concatenate([i, j]), minlength=e - s)
            root = list(range(e - s))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(i.tolist(), j.tolist()):
                a, b = find(a), find(b)
                if a != b:
                    a, b = (a, b) if keys[s + a] < keys[s + b] else (b, a)
                    root[b] = a
            out += [(keys[s + k], keys[s + find(k)], int(links[k])) for k in np.flatnonzero(links).tolist()]
        if out:
            a, b, n = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                                             names=["key", "root", "links"])


def _by_path(rows: DataFrame) -> DataFrame:
    return rows.repartition(session_size(rows), "path").sortWithinPartitions("path")


def _shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and sorted shingle hashes of the wanted texts, one row each."""
    def run(batches):
        for batch in batches:
            out = []
            for a, b, buf, off in _text_slices(batch.column(1)):
                h, rows = shingle_sets(buf, off)
                at = ts.word_offsets(rows, b - a)
                out += [h[at[k]:at[k + 1]].tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "shingles"])

    t = texts(docs).withColumn("key", text_key(F.col("text"))).alias("t")
    w = wanted.alias("w")
    same = (F.col("t.key") == F.col("w.key")) & F.col("t.doc_id").eqNullSafe(F.col("w.rep"))
    rows = t.join(w, same, "left_semi").dropDuplicates(["key"])
    return rows.select("key", "text").mapInArrow(run, "key binary, shingles binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, by alternating star steps."""
    checkpoint_dir(edges.sparkSession)
    e = edges.where("a <> b").distinct().checkpoint()
    before = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        side = down.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = side.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = mark


def groups(docs: DataFrame) -> DataFrame:
    """One row per different text: key, rep, n_copies, n_links, and of its group class_id and keeper (a key)."""
    checkpoint_dir(docs.sparkSession)
    sets = classes(docs).checkpoint()
    members = _members(sets, buckets(sets))
    active = _by_path(members).mapInArrow(_active, _MEMBER_SCHEMA).checkpoint()
    wanted = active.select("key").distinct().join(sets.select("key", "rep"), "key")
    full = active.join(_shingles(docs, wanted), "key")
    found = (_by_path(full.select(*active.columns, "shingles")).mapInArrow(_verify, "key binary, root binary, links long")
             .checkpoint())
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    parts = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    own = (sets.select("key", "rep", "n_copies").join(links, "key", "left")
           .join(parts.withColumnRenamed("node", "key"), "key", "left")
           .withColumn("label", F.coalesce("label", "key")))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("first")
    heads = own.where("n_links > 0").groupBy("label").agg(first)
    return (own.join(heads, "label", "left")
            .select("key", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("first").isNull(), F.col("rep")).otherwise(F.col("first.rep")).alias("class_id"),
                    F.coalesce("first.key", "key").alias("keeper")))


def linked(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, class_id, n_copies and n_links."""
    g = groups(docs).select("key", "class_id", "n_copies", "n_links")
    rows = texts(docs).select("doc_id", text_key(F.col("text")).alias("key"))
    return rows.join(g, "key").select("doc_id", "class_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each group the text of the smallest doc_id, once."""
    keep = groups(docs).where("key = keeper").select("key", "rep")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text_key(F.coalesce("text", F.lit(""))).alias("key")).alias("t")
    k = keep.alias("k")
    same = (F.col("t.key") == F.col("k.key")) & F.col("t.doc_id").eqNullSafe(F.col("k.rep"))
    return rows.join(k, same, "left_semi").dropDuplicates(["key", "doc_id"]).select("row.*")
