"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of folded words (ASCII and
Latin-1 letters in lower case, other ASCII characters delimit).  Items and texts that share
windows of ``SEED`` words are paired by a join; each pair is tiled: running
Karp-Rabin hashes find the longest common runs of unmarked words, which are
marked one after the other, longest first, until no run of ``SEED`` words is
left.  A document leaks an item when the tiles cover ``COVER`` of the item's
words, in whatever order the passages stand.

Before the join a bitmap of seed hashes, of a fixed ``FILTER_BITS`` bits
whatever the benchmark's size, passes over documents without any seed; what
it lets through by chance is removed by the join.  Pairs whose shared seeds,
as often as the item has them, could not cover enough are not tiled.  Equal texts are judged once.

Defined results: items of fewer than ``SEED`` words identify nothing and are
left out; items with equal words are one item, known by the smallest item_id;
null texts are empty and leak nothing; repeated rows get equal verdicts; an
empty table gives an empty result; an empty benchmark flags nothing; other
columns are ignored by ``verdicts`` and kept by ``clean``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm import textscan as ts
from retort.llm.common import text_key, texts
from retort.session import checkpoint_dir

SEED, COVER = 4, 0.6
FILTER_BITS = 1 << 23
_SEGMENT = 1 << 13
_FIRST_LENGTH = 16
_PAIRS = 1 << 20  # runs measured at once


class _Words:
    """One side of a tiling: words as small integers, prefix sums for hashes of any window, marks."""

    def __init__(self, words: np.ndarray, border: int):
        self.words, self.border, self.used = words, border, np.zeros(len(words), bool)
        power, self.inverse = ts._power_tables(len(words) + 1)
        codes = ts.mix(words.astype(ts.U) + ts.U(1))
        self.sums = np.append(ts.U(0), np.cumsum(codes * power[:len(words)]))

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        """Running Karp-Rabin hashes of the windows of ``size`` words at ``at``."""
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def free(self, n: int) -> np.ndarray:
        """Starts of windows of n unmarked words."""
        sums = np.append(0, np.cumsum(self.used))
        return np.flatnonzero(sums[n:] == sums[:-n]) if len(self.words) >= n else np.zeros(0, np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The word before each place; the side's border value at the start and behind a mark."""
        return np.where((at > 0) & ~self.used[at - 1], self.words[at - 1], self.border)

    def room(self) -> np.ndarray:
        """How many unmarked words stand from each place on."""
        stop = np.where(self.used, np.arange(len(self.words)), len(self.words))
        return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(self.words))


def _matches(item: _Words, text: _Words, n: int) -> np.ndarray:
    """(size, start in item, start in text) rows of the common runs of n unmarked words or more, longest first.

    A run is listed once, from its first word: places of the item are grouped
    by hash and by the word before them, and a place of the text skips those
    whose word before is its own.  So passages of equal words list as many
    runs as they have words, not all pairs of their windows.
    """
    own, other = item.free(n), text.free(n)
    none = np.zeros((0, 3), np.int64)
    if not len(own) or not len(other):
        return none
    group, h = np.unique(item.hashes(own, n), return_inverse=True)
    g = text.hashes(other, n)
    at = np.minimum(np.searchsorted(group, g), len(group) - 1)
    hit = group[at] == g
    other, at = other[hit], at[hit]
    width = max(int(item.words.max()), int(text.words.max())) + 4  # words are 0 or more, borders -1 and -2
    keys = h * width + item.before(own) + 2
    order = np.argsort(keys, kind="stable")
    own, keys = own[order], keys[order]
    lo, hi = np.searchsorted(keys, at * width), np.searchsorted(keys, (at + 1) * width)
    same = at * width + text.before(other) + 2
    skip, on = np.searchsorted(keys, same), np.searchsorted(keys, same, "right")
    count = (skip - lo) + (hi - on)
    room_i, room_t, found = item.room(), text.room(), [none]
    edges = np.append(0, np.cumsum(count))
    first = 0
    while first < len(other):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + _PAIRS, "right")) - 1)
        c = count[first:last]
        which = np.repeat(np.arange(first, last), c)
        nth = np.arange(len(which)) - np.repeat(edges[first:last] - edges[first], c)
        before = skip[which] - lo[which]
        place = lo[which] + nth + np.where(nth >= before, on[which] - skip[which], 0)
        i, t = own[place], other[which]
        size, top = np.full(len(i), n), np.minimum(room_i[i], room_t[t])
        while (size < top).any():
            middle = (size + top + 1) // 2
            equal = item.hashes(i, middle) == text.hashes(t, middle)
            size, top = np.where(equal, middle, size), np.where(equal, top, middle - 1)
        found.append(np.stack([size, i, t], 1))
        first = last
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))]


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(length, start in item, start in text) of the tiles, longest first (of ties the first in the item, then in the text).

    A run that marks cut goes back in parts, so each tile is the longest that is left.
    """
    if len(item) < least or len(text) < least:
        return []
    ids = np.unique(np.concatenate([item, text]), return_inverse=True)[1].astype(np.int64)
    a, b = _Words(ids[:len(item)], -1), _Words(ids[len(item):], -2)
    out, n = [], max(least, min(_FIRST_LENGTH, len(item)))
    while True:
        rows, cut, k = _matches(a, b, n), [], 0
        while k < len(rows) or cut:
            if cut and (k == len(rows) or cut[0] <= (-int(rows[k, 0]), int(rows[k, 1]), int(rows[k, 2]))):
                size, i, t = heapq.heappop(cut)
                size = -size
            else:
                size, i, t = rows[k].tolist()
                k += 1
            fits = ~(a.used[i:i + size] | b.used[t:t + size]) & (a.words[i:i + size] == b.words[t:t + size])
            if fits.all():
                a.used[i:i + size] = b.used[t:t + size] = True
                out.append((size, i, t))
                if not len(a.free(n)):
                    break
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], fits, [False]]).astype(np.int8))).reshape(-1, 2)
                for lo, hi in edge[edge[:, 1] - edge[:, 0] >= n].tolist():
                    heapq.heappush(cut, (lo - hi, i + lo, t + lo))
        if n <= least:
            return out
        n = max(least, n // 2)


def items(benchmark: DataFrame) -> DataFrame:
    """One row per different item: item_id, words (hashes), n_words, seeds (hashes of its windows) and how often each occurs."""
    def run(batches):
        for batch in batches:
            buf, off = ts.text_bytes(batch.column(1))
            h, rows = ts.folded_words(buf, off)
            at = ts.word_offsets(rows, len(off) - 1)
            words = [h[at[k]:at[k + 1]] for k in range(len(off) - 1)]
            seeds = [np.unique(ts.ngrams(w, np.zeros(len(w), np.int64), SEED)[0], return_counts=True) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()),
                 pa.array([len(w) for w in words], pa.int32()), pa.array([g.view(np.int64) for g, _ in seeds], pa.list_(pa.int64())),
                 pa.array([n for _, n in seeds], pa.list_(pa.int64()))],
                names=["item_id", "words", "n_words", "seeds", "times"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.mapInArrow(run, "item_id long, words binary, n_words int, seeds array<long>, times array<long>")
            .where(F.col("n_words") >= SEED).groupBy("words")
            .agg(F.min("item_id").alias("item_id"), F.any_value("n_words").alias("n_words"),
                 F.any_value("seeds").alias("seeds"), F.any_value("times").alias("times")))


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The bitmap of seed hashes, ``FILTER_BITS`` / 8 bytes."""
    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(_SEGMENT, np.uint8)
        bits[t.column("bit").to_numpy()] = 1
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bit = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = (seeds.select(F.floor(bit / _SEGMENT).cast("int").alias("part"), (bit % _SEGMENT).cast("int").alias("bit"))
             .distinct().groupBy("part").applyInArrow(pack, "part int, bits binary").collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[r["part"] * (_SEGMENT // 8):(r["part"] + 1) * (_SEGMENT // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidates(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """key, text and hits (seed hashes the bitmap lets through) of the different texts that have any."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            bits = shared.value
            buf, off = ts.text_bytes(batch.column(1))
            at, hits = [], []
            for lo, hi in ts.slices(off):
                h, rows = ts.folded_words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                g, first = ts.ngrams(h, rows, SEED)
                place = (g & ts.U(FILTER_BITS - 1)).astype(np.int64)
                ok = np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                r = rows[first[ok]]
                for i in np.unique(r):
                    at.append(lo + i)
                    hits.append(np.unique(g[ok[r == i]]).view(np.int64))
            if at:
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(hits, pa.list_(pa.int64()))],
                                                 names=["key", "text", "hits"])

    rows = texts(docs).select(text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, "key binary, text string, hits array<long>").dropDuplicates(["key"])


def _tile_rows(batches):
    for batch in batches:
        keys, ids, cover, tiles = [], [], [], []
        buf, off = ts.text_bytes(batch.column(1))
        for k, found in enumerate(batch.column(2).to_pylist()):
            text, _ = ts.folded_words(buf[off[k]:off[k + 1]], np.array([0, off[k + 1] - off[k]]))
            for x in found:
                words = np.frombuffer(x["words"], ts.U)
                out = tile(words, text)
                keys.append(batch.column(0)[k].as_py())
                ids.append(x["item_id"])
                cover.append(sum(n for n, _, _ in out) / len(words))
                tiles.append(len(out))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(cover),
                                          pa.array(tiles, pa.int32())], names=["key", "item_id", "coverage", "n_tiles"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, item_id, coverage and n_tiles of every text and item whose tiles cover enough."""
    checkpoint_dir(docs.sparkSession)
    known = items(benchmark).withColumn("item", F.unhex(F.md5("words"))).checkpoint()
    seeds = (known.select("item", "n_words", F.explode(F.arrays_zip("seeds", "times")).alias("s"))
             .select("item", "n_words", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times")))
    found = candidates(docs, seed_filter(seeds)).checkpoint()
    pairs = (found.select("key", F.explode("hits").alias("seed")).join(seeds, "seed")
             .groupBy("key", "item", "n_words").agg(F.sum("times").alias("shared"))
             .where(F.col("shared") * SEED >= COVER * F.col("n_words")))
    lists = (pairs.select("key", "item").join(known.select("item", "words", "item_id"), "item")
             .groupBy("key").agg(F.collect_list(F.struct("item_id", "words")).alias("found")))
    return (found.select("key", "text").join(lists, "key").select("key", "text", "found")
            .mapInArrow(_tile_rows, "key binary, item_id long, coverage double, n_tiles int")
            .where(F.col("coverage") >= COVER))


def _best(found: DataFrame) -> DataFrame:
    """Per text the number of leaked items and the best covered one (of ties the smallest id)."""
    best = F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", -F.col("item_id")))
    return (found.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), best.alias("best"))
            .select("key", "n_items", "best.*"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input row: doc_id, leaked, n_items, and the best covered item (null if none)."""
    rows = texts(docs).select("doc_id", text_key(F.col("text")).alias("key"))
    return (rows.join(_best(leaks(docs, benchmark)), "key", "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    "item_id", "coverage", "n_tiles"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that leak no item.

    Rows are matched by (doc_id, text), so copies of a leaked text are spread over all tasks.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text_key(F.coalesce("text", F.lit(""))).alias("key"))
    bad = rows.select("doc_id", "key").join(leaks(docs, benchmark).select("key").distinct(), "key").distinct().alias("b")
    same = (F.col("t.key") == F.col("b.key")) & F.col("t.doc_id").eqNullSafe(F.col("b.doc_id"))
    return rows.alias("t").join(bad, same, "left_anti").select("row.*")
