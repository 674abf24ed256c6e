"""Vocabulary training on Spark: byte-level BPE and Unigram (EM).

Both work on the distinct-word table (word, count), which is written once,
so the corpus is read once; every round is one distributed aggregation, and
only changed pair counts (BPE) or sums (Unigram, whose piece table stays a table)
reach the driver.  Long loops cut lineage with
reliable ``checkpoint()`` into the session's checkpoint folder.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.operators.tokenizer import CHAR_OF, _code_points, _Table
from retort.plans.rowindex import global_index
from retort.session import checkpoint_dir

# GPT-2 style byte-level pre-tokenizer pattern.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_words(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n): pre-tokenised words of the corpus with their counts."""
    w = (df.select(F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(BYTE_LEVEL_SPLIT), 0)).alias("word"))
         .where(F.col("word").isNotNull()))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


BLOCK_SYMBOLS = 1 << 20  # symbols of the words that are kept together


def _numbers(raw, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if wide else np.uint16)


def _packed(wide: bool):
    """Words with their counts -> blocks: the numbers of their symbols, each word ended by 0, and a count a word.

    A byte's symbol is its value plus one.  Words of one symbol have no pair and are left out.
    """
    def run(batches):
        import pyarrow as pa

        def block(words, counts):
            raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
            size = np.array([len(w) for w in words])
            s = raw.astype(np.uint32 if wide else np.uint16) + 1
            s[np.cumsum(size + 1) - 1] = 0
            return _block_row(s, np.array(counts, np.int64))

        words, counts, room = [], [], BLOCK_SYMBOLS
        for batch in batches:
            for w, n in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                if w and len(w) > 1:
                    words.append(w)
                    counts.append(n)
                    room -= len(w) + 1
                if room <= 0:
                    yield block(words, counts)
                    words, counts, room = [], [], BLOCK_SYMBOLS
        if words:
            yield block(words, counts)
    return run


def _block_row(s: np.ndarray, n: np.ndarray):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["s", "n"])


def _blocks_of(batches, wide: bool):
    for batch in batches:
        for s, n in zip(batch.column(0), batch.column(1)):
            yield _numbers(s.as_buffer(), wide), np.frombuffer(n.as_buffer(), np.int64)


def _pairs_at(s: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places of the pair (a, b); of a run of overlapping ones every second, from the left."""
    at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
    if a == b and len(at):
        fresh = np.append(True, np.diff(at) > 1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
    return at


def _merged(s: np.ndarray, merges: list) -> np.ndarray:
    """Symbols after the merges (left, right, new), in order (left to right, none overlap)."""
    for a, b, new in merges:
        at = _pairs_at(s, a, b)
        if len(at):
            s = s.copy()
            s[at] = new
            s = np.delete(s, at + 1)
    return s


def _holding(s: np.ndarray, n: np.ndarray, merges: list):
    """The words, with their counts, that hold one of the merges' pairs; the others stay as they are."""
    hit = np.zeros(len(n), bool)
    word = None
    for a, b, _ in merges:
        at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
        if len(at):
            word = np.cumsum(s == 0, dtype=np.int32) - (s == 0) if word is None else word
            hit[word[at]] = True
    return (s[hit[word]], n[hit]) if word is not None else (s[:0], n[:0])


def _pair_counts(s: np.ndarray, n: np.ndarray, sign: int):
    """(left << 32 | right, signed count) of all pairs of neighbours in the words."""
    at = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0))
    word = np.cumsum(s == 0, dtype=np.int32)[at]
    return s[at].astype(np.int64) << 32 | s[at + 1], sign * n[word]


def _pair_changes(done: list, fresh: list, wide: bool):
    """What ``fresh`` merges, made after the ``done`` ones, change in the counts of pairs of a partition's blocks.

    Only words that hold a merged pair are counted again; without ``fresh`` all pairs are counted.
    """
    def run(batches):
        import pyarrow as pa
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s, n in _blocks_of(batches, wide):
            s = _merged(s, done)
            parts = [(keys, sums)]
            if fresh:
                s, n = _holding(s, n, fresh)
                parts.append(_pair_counts(s, n, -1))
                s = _merged(s, fresh)
            parts.append(_pair_counts(s, n, 1))
            key, k = (np.concatenate(x) for x in zip(*parts))
            keys, code = np.unique(key, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, code, k)
        left, right, k = (x[sums != 0] for x in (keys >> 32, keys & 0xFFFFFFFF, sums))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(k, pa.int64())],
                                         names=["left", "right", "k"])
    return run


def _apply(merges: list, wide: bool):
    """Blocks after the merges, without the words that became one symbol."""
    def run(batches):
        for s, n in _blocks_of(batches, wide):
            s = _merged(s, merges)
            end = np.flatnonzero(s == 0)
            size = np.diff(np.append(-1, end))
            yield _block_row(s[np.repeat(size > 2, size)], n[size > 2])
    return run


def _alphabet():
    def run(batches):
        import pyarrow as pa
        seen = np.zeros(256, bool)
        for batch in batches:
            for w in batch.column(0).cast(pa.binary()):
                if w.is_valid:
                    seen[np.frombuffer(w.as_buffer(), np.uint8)] = True
        yield pa.RecordBatch.from_arrays([pa.array([CHAR_OF[b] for b in np.flatnonzero(seen).tolist()], pa.string())], names=["token"])
    return run


def _next_merges(counts: dict, made: set, room: int, min_count: int) -> list:
    """The longest run of next merges, at most ``room``, that one round can make with the result of single rounds.

    A merge (a, b) changes the counts of pairs (b, x) and (x, a) only, and a new
    pair occurs no more often than one of these.  So a pair may follow while it
    is not one of these and they are all rarer.
    """
    order = heapq.nsmallest(256, counts.items(), key=lambda x: (-x[1], x[0]))
    batch: list = []
    lefts, rights = set(), set()
    changed = lambda p: p[0] in rights or p[1] in lefts
    for i, (pair, c) in enumerate(order):
        if c < min_count or len(batch) == room:
            break
        if batch:
            ties = [p for p, k in order[i:] if k == c]
            if any(map(changed, ties)) or order[-1][1] == c and len(order) < len(counts):
                break
        batch.append((*pair, c))
        lefts.add(pair[0])
        rights.add(pair[1])
        new = pair[0] + pair[1]
        if pair[0] == pair[1] or new in made:  # pairs of the new symbol may be as frequent as any
            break
        made.add(new)
    return batch


def train_bpe(words: DataFrame, num_merges: int, checkpoint_every: int = 10, min_count: int = 1):
    """Byte-level BPE.  Returns (merges DataFrame(rank, left, right, count), alphabet DataFrame(token)).

    Adjacent pairs, weighted by word count, are counted once; then each round
    takes the best pair by (count desc, left, right), and those after it that
    it cannot change, and counts anew only the words that hold them (one
    aggregation of the changes).  The driver holds the pair counts, at most
    the square of the vocabulary.  Ties are broken by the symbols' text.
    Words are kept in blocks of about a million symbols, as numbers, so that a
    merge is an array pass; the blocks are written before the first round and
    every ``checkpoint_every`` rounds.  Merges end early only when no pair
    occurs ``min_count`` times.
    """
    spark = words.sparkSession
    checkpoint_dir(spark)
    wide = 257 + num_merges > 0xFFFF
    rows = "s binary, n binary"
    words = words.select("word", "n").checkpoint()
    alphabet = words.select("word").mapInArrow(_alphabet(), "token string").distinct()
    cur = words.mapInArrow(_packed(wide), rows).checkpoint()
    names = ["", *(CHAR_OF[b] for b in range(256))]
    number = {x: i for i, x in enumerate(names)}
    counts: dict = {}
    made: set = set()
    merges: list = []
    done: list = []
    fresh: list = []
    rounds = 0
    while True:
        changes = (cur.mapInArrow(_pair_changes(done, fresh, wide), "left long, right long, k long")
                   .groupBy("left", "right").agg(F.sum("k").alias("k")).where("k != 0").collect())
        for x in changes:
            pair = (names[x["left"]], names[x["right"]])
            counts[pair] = counts.get(pair, 0) + x["k"]
            if not counts[pair]:
                del counts[pair]
        done = done + fresh
        best = _next_merges(counts, made, num_merges - len(merges), min_count)
        if not best:
            break
        merges += [(len(merges) + i, a, b, int(c)) for i, (a, b, c) in enumerate(best)]
        if len(merges) == num_merges:
            break
        for a, b, _ in best:
            if a + b not in number:  # two pairs may make the same symbol
                number[a + b] = len(names)
                names.append(a + b)
        fresh = [(number[a], number[b], number[a + b]) for a, b, _ in best]
        rounds += 1
        if rounds % checkpoint_every == 0:
            cur, done = cur.mapInArrow(_apply(done, wide), rows).checkpoint(), []
    out = spark.createDataFrame(merges, "rank int, left string, right string, count long")
    return out, alphabet


# ------------------------------------------------------------------ unigram

class _Pieces:
    """Where pieces occur in words, found in array passes.

    All words and pieces are laid end to end.  Windows of 1, 2, 4, 8 ... characters
    are ranked, equal ones alike; a substring of any other length is known, exactly,
    by the ranks of the two windows that cover it.
    """

    def __init__(self, words: list, pieces: list, max_len: int):
        self.cp, off = _code_points(words + pieces)
        self.off, at = off[:len(words) + 1], off[len(words):-1]
        self.ranks = [self.cp]
        while 2 ** len(self.ranks) < max_len:
            self.ranks.append(self._ranked(self.ranks[-1], 2 ** (len(self.ranks) - 1)))
        size = np.diff(off[len(words):])
        self.tables = {int(m): _Table(self.keys(at[size == m], int(m)), np.flatnonzero(size == m)) for m in np.unique(size)}

    @staticmethod
    def _ranked(rank: np.ndarray, w: int) -> np.ndarray:
        import pandas as pd
        return pd.factorize(rank << 32 | np.append(rank[w:], np.zeros(min(w, len(rank)), np.int64)))[0].astype(np.int64)

    def keys(self, at: np.ndarray, m: int) -> np.ndarray:
        """Of the substrings of ``m`` characters at these places: equal keys for equal ones."""
        if m == 1:
            return self.cp[at]
        k = (m - 1).bit_length() - 1
        return self.ranks[k][at] << 32 | self.ranks[k][at + m - 2 ** k]

    def places(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, its word, characters from there to the word's end) of the words lo to hi - 1."""
        place = np.arange(self.off[lo], self.off[hi])
        word = np.repeat(np.arange(lo, hi), np.diff(self.off[lo:hi + 1]))
        return place, word, self.off[word + 1] - place

    def edges(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of all pieces in the words lo to hi - 1."""
        place, word, room = self.places(lo, hi)
        out = [(place[:0],) * 4]
        for m, table in self.tables.items():
            fits = np.flatnonzero(room >= m)
            found = table[self.keys(place[fits], m)]
            fits, found = fits[found >= 0], found[found >= 0]
            out.append((word[fits], place[fits], place[fits] + m, found))
        return tuple(np.concatenate(x) for x in zip(*out))

    def strings(self, at: np.ndarray, m: int):
        """The substrings of ``m`` characters at these places, as an Arrow array."""
        import pyarrow as pa
        flat = self.cp[at[:, None] + np.arange(m)].ravel()
        width = 1 + (flat >= 0x80).astype(np.int32) + (flat >= 0x800) + (flat >= 0x10000)
        ends = np.append(0, np.cumsum(width))[::m].astype(np.int32)
        raw = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(raw))


def _substrings(lengths, base: int = 0):
    """(words, pieces) of one block -> block, piece, n: the occurrences of its substrings of these lengths.

    ``pieces`` are the frequent ones of ``base`` characters; a longer substring is only
    listed if all its parts of ``base`` characters are among them.
    """
    def run(words, pieces):
        import pandas as pd
        import pyarrow as pa
        n = words["n"].to_numpy() if "n" in words.column_names else np.ones(len(words), np.int64)
        known = pieces["piece"].to_pylist() if pieces is not None else []
        p = _Pieces(words["word"].to_pylist(), known, max(lengths))
        place, word, room = p.places(0, len(words))
        listed = np.ones(len(place) + 1, bool)
        if base:
            listed[:] = False
            fits = place[room >= base]
            if base in p.tables:
                listed[fits] = p.tables[base][p.keys(fits, base)] >= 0
        block = words["block"][0].as_py() if len(words) else 0
        out = []
        for m in lengths:
            hit = room >= m
            for d in range(m - base + 1 if base else 0):
                hit[:len(hit) - d] &= listed[d:len(hit)]
            at = place[hit]
            code, first = pd.factorize(p.keys(at, m))
            count, spot = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            np.add.at(count, code, n[word[hit]])
            spot[code] = at
            out.append(pa.table({"block": pa.array(np.full(len(first), block, np.int64)), "piece": p.strings(spot, m), "n": count}))
        return pa.concat_tables(out)
    return run if base else lambda words: run(words, None)


def _spread(df: DataFrame, key: str, chars: int = 300_000) -> DataFrame:
    """Rows with ``block``: a hash of the key over as many blocks as keep about ``chars`` characters each."""
    total = df.agg(F.sum(F.length(key)).alias("t")).first()["t"] or 0
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(total // chars + 1)))


_HELD = "block long, piece string, n long"


def _frequent(blocks: DataFrame, max_len: int, min_freq: int) -> DataFrame:
    """(block, piece, freq): the candidate pieces that each block's words hold, and how often all words hold them.

    Candidates are all characters and the substrings of at most ``max_len`` characters that occur
    ``min_freq`` times.  They are counted by rising length, two lengths a round after the first
    four: a substring is no more frequent than its parts, so one with a rare part is not counted.
    """
    found, base = [], 0
    while base < max_len:
        lengths = range(base + 1, min(base + (2 if base else 4), max_len) + 1)
        if base:
            shorter = found[-1].where(F.length("piece") == base)
            counted = blocks.groupBy("block").cogroup(shorter.select("block", "piece").groupBy("block")).applyInArrow(
                _substrings(lengths, base), _HELD)
        else:
            counted = blocks.groupBy("block").applyInArrow(_substrings(lengths), _HELD)
        found.append(counted.withColumn("freq", F.sum("n").over(Window.partitionBy("piece")))
                     .where((F.length("piece") == 1) | (F.col("freq") >= min_freq)).select("block", "piece", "freq").checkpoint())
        base = lengths[-1]
        if found[-1].where(F.length("piece") == base).isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _dealt(words: DataFrame) -> DataFrame:
    words = words.select("word", "n").where(F.length("word") > 0).checkpoint()
    return _spread(words, "word").checkpoint()


def seed_pieces(words: DataFrame, max_len: int, min_freq: int) -> DataFrame:
    """Candidate pieces: all substrings of at most ``max_len`` characters that occur ``min_freq`` times, and all characters."""
    checkpoint_dir(words.sparkSession)
    return _frequent(_dealt(words), max_len, min_freq).select("piece", "freq").distinct()


SLICE_CHARS = 100_000


def _slices(off: np.ndarray):
    """Ranges of words of about ``SLICE_CHARS`` characters; a longer word stands alone."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_CHARS, "right")) - 1)
        yield lo, hi
        lo = hi


def _log_sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of the runs of values that begin at ``first``."""
    top = np.maximum.reduceat(value, first)
    top[top == -np.inf] = 0
    with np.errstate(divide="ignore"):
        return top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(first, len(value))))), first))


def _passed(states: int, turn: np.ndarray, here: np.ndarray, there: np.ndarray, score: np.ndarray, begin: np.ndarray, total) -> np.ndarray:
    """Values of all states, turn by turn: at ``begin`` 0, else the total over the edges (there -> here, score)."""
    value = np.full(states, -np.inf)
    value[begin] = 0
    order = np.argsort(turn * states + here)
    turn, here, there, score = turn[order], here[order], there[order], score[order]
    cuts = np.flatnonzero(np.append(True, turn[1:] != turn[:-1])).tolist() if len(turn) else []
    for a, b in zip(cuts, [*cuts[1:], len(turn)]):
        first = np.flatnonzero(np.append(True, here[a + 1:b] != here[a:b - 1]))
        value[here[a:b][first]] = total(value[there[a:b]] + score[a:b], first)
    return value


def _expected(max_len: int):
    """E-step of one block: (its words, the scores of the pieces they hold) -> expected counts."""
    def run(words, pieces):
        import pyarrow as pa
        score, n = pieces["score"].to_numpy(), words["n"].to_numpy()
        p = _Pieces(words["word"].to_pylist(), pieces["piece"].to_pylist(), max_len)
        out = np.zeros(len(score))
        for lo, hi in _slices(p.off):
            word, start, end, piece = p.edges(lo, hi)
            # a word of L characters has L + 1 states
            begin = p.off[lo:hi] - p.off[lo] + np.arange(hi - lo)
            stop = begin + np.diff(p.off[lo:hi + 1])
            word = word - lo
            a, b = start - p.off[lo] + word, end - p.off[lo] + word
            states, s = int(stop[-1]) + 1, score[piece]
            fwd = _passed(states, b - begin[word], b, a, s, begin, _log_sums)
            bwd = _passed(states, stop[word] - a, a, b, s, stop, _log_sums)
            z = fwd[stop]
            with np.errstate(invalid="ignore"):
                share = np.exp(fwd[a] + s + bwd[b] - z[word])
            share[z[word] == -np.inf] = 0
            out += np.bincount(piece, n[lo + word] * share, len(score))
        keep = out > 0
        if 1 in p.tables:
            keep[p.tables[1].values] = True  # single characters stay, whatever their count
        return pa.table({"piece": pieces["piece"].filter(pa.array(keep)), "expected": out[keep]})
    return run


def _losses(max_len: int):
    """Loss of one block's pieces: expected count times what the score is above the best segmentation into others."""
    def run(own, pieces):
        import pyarrow as pa
        score = pieces["score"].to_numpy()
        p = _Pieces(own["word"].to_pylist(), pieces["piece"].to_pylist(), max_len)
        loss = np.zeros(len(own))
        for lo, hi in _slices(p.off):
            word, start, end, piece = p.edges(lo, hi)
            begin = p.off[lo:hi] - p.off[lo] + np.arange(hi - lo)
            stop = begin + np.diff(p.off[lo:hi + 1])
            word = word - lo
            a, b, s = start - p.off[lo] + word, end - p.off[lo] + word, score[piece]
            whole = (a == begin[word]) & (b == stop[word])
            best = _passed(int(stop[-1]) + 1, *(x[~whole] for x in (b - begin[word], b, a, s)), begin, np.maximum.reduceat)[stop]
            mine = np.full(hi - lo, -np.inf)
            mine[word[whole]] = s[whole]
            loss[lo:hi] = own["expected"].to_numpy()[lo:hi] * (mine - best)
        return pa.table({"piece": own["word"], "loss": loss})
    return run


def _ranges(rows: int) -> int:
    return rows // 100_000 + 1


def train_unigram(words: DataFrame, vocab_size: int, specials=("<pad>", "</s>", "<unk>"), max_len: int = 16,
                  min_freq: int = 2, sub_rounds: int = 2, shrink: float = 0.75) -> DataFrame:
    """Unigram LM vocabulary: EM rounds, each followed by pruning on the loss of likelihood.

    Words and pieces stay tables.  The distinct words are dealt into blocks of
    about 300,000 characters; which candidates a block's words hold comes out of
    counting them (``_frequent``), and each round a block meets their scores by
    a join.  E-step (forward-backward of all words of a slice at once, weighted
    by their counts) and losses run per block in array passes; expected counts
    are summed by a ``groupBy``.  A piece's loss is its expected count times
    what its score is above the best segmentation into other pieces; after
    ``sub_rounds`` EM rounds the share ``shrink`` of largest loss stays (exact
    positions), down to the vocabulary size.  Single characters always stay.
    The driver gets counts and sums only.  Returns (token, id, score), specials
    first.
    """
    spark = words.sparkSession
    checkpoint_dir(spark)
    blocks = _dealt(words)
    held = _frequent(blocks, max_len, min_freq)
    seed = held.select("piece", "freq").distinct().checkpoint()
    total = seed.agg(F.sum("freq").alias("t")).first()["t"] or 1
    scores = seed.select("piece", F.log(F.col("freq") / F.lit(total)).alias("score"))
    target = vocab_size - len(specials)
    while True:
        held = held.select("block", "piece").join(scores, "piece").checkpoint()
        for k in range(sub_rounds):
            scored = held.select("block", "piece").join(scores, "piece") if k else held
            counts = (blocks.groupBy("block").cogroup(scored.groupBy("block"))
                      .applyInArrow(_expected(max_len), "piece string, expected double")
                      .groupBy("piece").agg(F.sum("expected").alias("expected")).checkpoint())
            z = counts.agg(F.sum("expected").alias("z")).first()["z"] or 1.0
            table = (counts.where((F.col("expected") > 0) | (F.length("piece") == 1))
                     .withColumn("score", F.log(F.greatest("expected", F.lit(1e-30)) / F.lit(z))))
            scores = table.select("piece", "score")
        multi = table.where(F.length("piece") > 1)
        n, n_multi = table.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.length("piece") > 1).cast("long")), F.lit(0))).first()
        if n <= target or not n_multi:
            break
        room = max(max(target, int(n * shrink)) - (n - n_multi), 0)
        own = _spread(multi.select(F.col("piece").alias("word"), "expected"), "word").checkpoint()
        parts = own.groupBy("block").applyInArrow(_substrings(range(1, max_len + 1)), _HELD).select("block", "piece")
        losses = (own.groupBy("block").cogroup(parts.join(scores, "piece").groupBy("block"))
                  .applyInArrow(_losses(max_len), "piece string, loss double")).checkpoint()  # dealing by ranges reads them twice
        stay = global_index(losses, [F.desc("loss"), "piece"], buckets=_ranges(n_multi), total_col=None).where(F.col("idx") < room).select("piece")
        stay = stay.unionByName(table.where(F.length("piece") == 1).select("piece"))
        scores = scores.join(stay, "piece", "left_semi").checkpoint()
        if n - n_multi + min(room, n_multi) <= max(target, n - n_multi):
            break
    first = spark.createDataFrame([(s, i, 0.0) for i, s in enumerate(specials)], "token string, id long, score double")
    final = global_index(scores, [F.desc("score"), "piece"], buckets=_ranges(scores.count()), total_col=None)
    return first.unionByName(final.select(F.col("piece").alias("token"), (F.col("idx") + len(specials)).cast("long").alias("id"),
                                          "score"))
