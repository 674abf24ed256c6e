"""Subword tokenisers applied in place: no shuffle, no row key.

A ``Tokenizer`` holds a trained vocabulary (bounded by its training target;
``load`` refuses more than ``MAX_VOCAB`` rows) and is shipped once per
executor.  ``encode`` and ``decode`` are Arrow column functions: the pieces of
a batch are flattened, every different piece is segmented once, all of them
together in array passes (``BestPaths``, ``Merges``), and the ids are gathered
back behind the same list offsets.

Segmentations: ``word`` (a piece is a token or unknown), ``char`` (every
character is a token), ``unigram`` (best path of token scores) and ``bpe``
(merges in the order of their ranks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_VOCAB = 2_000_000
UNKNOWN_GAP = 10.0  # an unknown character scores this much below the worst token


class Tokenizer:
    def __init__(self, kind: str, ids: dict[str, int], unk_id: int = 2, scores: dict[str, float] | None = None,
                 merges: list[tuple[str, str]] | None = None, prefix=(), suffix=(1,), specials=(0, 1, 2),
                 byte_level: bool = False):
        if kind not in ("word", "char", "unigram", "bpe"):
            raise ValueError(f"unknown segmentation {kind!r}")
        self.kind, self.ids, self.unk_id, self.byte_level = kind, ids, unk_id, byte_level
        self.scores = scores or {}
        self.ranks = {pair: r for r, pair in enumerate(merges or [])}
        self.prefix, self.suffix, self.specials = tuple(prefix), tuple(suffix), frozenset(specials)
        self.longest = max(map(len, self.scores), default=1)
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_GAP
        self.tokens = {i: t for t, i in ids.items()}

    @staticmethod
    def load(kind: str, vocab: DataFrame, merges: DataFrame | None = None, **options) -> "Tokenizer":
        """From a (token, id[, score]) table and, for BPE, a (rank, left, right) table."""
        columns = [c for c in ("token", "id", "score") if c in vocab.columns]
        rows = vocab.select(*columns).limit(MAX_VOCAB + 1).collect()
        if len(rows) > MAX_VOCAB:
            raise ValueError(f"a vocabulary holds at most {MAX_VOCAB} tokens")
        scores = {r["token"]: r["score"] for r in rows} if "score" in columns else None
        pairs = None
        if merges is not None:
            pairs = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
        return Tokenizer(kind, {r["token"]: int(r["id"]) for r in rows}, scores=scores, merges=pairs, **options)

    def segment(self, piece: str) -> list[str]:
        if self.byte_level:
            piece = "".join(CHAR_OF[b] for b in piece.encode())
        if self.kind == "word":
            return [piece]
        if self.kind == "char":
            return list(piece)
        return self._best_path(piece) if self.kind == "unigram" else self._merge(list(piece))

    def _best_path(self, piece: str) -> list[str]:
        n = len(piece)
        best, came = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                score = self.scores.get(piece[start:end], self.floor if end - start == 1 else None)
                if score is not None and best[start] + score > best[end]:
                    best[end], came[end] = best[start] + score, start
        out, end = [], n
        while end:
            out.append(piece[came[end]:end])
            end = came[end]
        return out[::-1]

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            pairs = list(zip(symbols, symbols[1:]))
            pair = min(pairs, key=lambda p: self.ranks.get(p, 1 << 60))
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids.get(t, self.unk_id) for t in self.segment(piece)]

    def flat_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces one after the other, and their number by piece."""
        if self.kind in ("word", "char"):
            lists = [self.piece_ids(w) for w in pieces]
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
        if not hasattr(self, "_machine"):  # built once in every worker, not shipped
            self._machine = BestPaths(self) if self.kind == "unigram" else Merges(self)
        return self._machine.run(pieces)

    def word_ids(self, words: pa.Array) -> np.ndarray:
        """The id of every word that is looked up whole; unknown ones and nulls get ``unk_id``."""
        if not hasattr(self, "_words"):
            self._words = pa.array(list(self.ids), pa.string()), np.array([*self.ids.values(), self.unk_id], np.int32)
        names, ids = self._words
        return ids[pc.index_in(words, value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False)]

    def id_bytes(self, skip_special: bool):
        """(row of an id, all bytes, first byte and number of bytes by row): what ids stand for; unknown ones, last, for nothing."""
        if not hasattr(self, "_bytes"):
            self._bytes = {}
        if skip_special not in self._bytes:
            ids = [i for i in self.tokens if not (skip_special and i in self.specials)]
            # bytes that are not UTF-8 become replacement characters, symbols beyond the byte alphabet question marks
            raw = [bytes(BYTE_OF.get(c, 63) for c in self.tokens[i]) if self.byte_level else self.tokens[i].replace("▁", " ").encode() for i in ids]
            count = np.array([*map(len, raw), 0], np.int64)
            self._bytes[skip_special] = (_Table(ids, np.arange(len(ids))), np.frombuffer(b"".join(raw), np.uint8),
                                         np.append(0, np.cumsum(count)[:-1]), count)
        return self._bytes[skip_special]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_machine", "_words", "_bytes")}


def _code_points(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all pieces and the offsets of each."""
    raw = "".join(pieces).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").astype(np.int64), np.append(0, np.cumsum([len(w) for w in pieces], dtype=np.int64))


class _Table:
    """Whole numbers looked up in sorted arrays; what is missing is -1."""

    def __init__(self, keys, values):
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], -1)


class BestPaths:
    """Best segmentations of many pieces at once.

    The tokens form a trie over code points, kept as one sorted array of
    (node, code point) -> node.  All positions of all pieces walk it together,
    one character a step; every token that ends on the way is an edge.  Then
    the end positions are taken in turn: the best way to position t of every
    piece is the best of its edges, of equal ones that of the longest token.
    """

    _WIDTH = 0x110000

    def __init__(self, tok: Tokenizer):
        nodes: dict = {}
        token, score = [-1], [0.0]
        for t, s in tok.scores.items():
            at = 0
            for c in map(ord, t):
                key = at * self._WIDTH + c
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                    score.append(0.0)
                at = nodes[key]
            if t:
                token[at], score[at] = tok.ids.get(t, tok.unk_id), s
        self.next = _Table(list(nodes), list(nodes.values()))
        self.token, self.score = np.array(token, np.int64), np.array(score)
        self.ends = np.zeros(len(token), bool)
        for t in tok.scores:
            at = 0
            for c in map(ord, t):
                at = nodes[at * self._WIDTH + c]
            self.ends[at] = bool(t)
        self.floor, self.unk = tok.floor, tok.unk_id

    def _edges(self, cp: np.ndarray, stop: np.ndarray):
        """(start, end, score, id) of all tokens in the pieces, and of unknown characters."""
        at, node, out, d = np.arange(len(cp)), np.zeros(len(cp), np.int64), [], 0
        while len(at):
            d += 1
            node = self.next[node * self._WIDTH + cp[at + d - 1]]
            if d == 1:
                lone = at[(node < 0) | ~self.ends[node]]
                out.append((lone, lone + 1, np.full(len(lone), self.floor), np.full(len(lone), self.unk)))
            at, node = at[node >= 0], node[node >= 0]
            hit = self.ends[node]
            out.append((at[hit], at[hit] + d, self.score[node[hit]], self.token[node[hit]]))
            go = at + d < stop[at]
            at, node = at[go], node[go]
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4

    def run(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, off = _code_points(pieces)
        size = np.diff(off)
        piece = np.repeat(np.arange(len(pieces)), size)
        start, end, score, ids = self._edges(cp, off[1:][piece])
        # states are numbered by position: piece p has size + 1 of them from off[p] + p
        shift = piece[start]
        local = end - off[shift]
        order = np.lexsort((start, shift, local))
        start, end, score, ids, local = start[order] + shift[order], end[order] + shift[order], score[order], ids[order], local[order]
        states = len(cp) + len(pieces)
        best, came, via = np.zeros(states), np.zeros(states, np.int64), np.zeros(states, np.int64)
        turns = np.searchsorted(local, np.arange(1, (int(size.max()) if len(size) else 0) + 2))
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
            value = best[start[a:b]] + score[a:b]
            first = np.flatnonzero(np.append(True, end[a + 1:b] != end[a:b - 1]))
            top = np.maximum.reduceat(value, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
            hits = np.flatnonzero(value == top[group])
            hits = hits[np.append(True, group[hits][1:] != group[hits][:-1])]  # the first: the smallest start
            to = end[a:b][first]
            best[to], came[to], via[to] = top, start[a:b][hits], ids[a:b][hits]
        begin = off[:-1] + np.arange(len(pieces))
        at, on_path = begin + size, np.zeros(states, bool)
        at = at[at > begin]
        begins = np.zeros(states, bool)
        begins[begin] = True
        while len(at):
            on_path[at] = True
            at = came[at]
            at = at[~begins[at]]
        chosen = np.flatnonzero(on_path)
        count = np.bincount(np.searchsorted(begin, chosen, "right") - 1, minlength=len(pieces)) if len(pieces) else np.zeros(0, np.int64)
        return via[chosen].astype(np.int32), count.astype(np.int64)


class Merges:
    """Merges of many pieces at once: in every turn each piece makes its merge of least rank, everywhere it occurs."""

    def __init__(self, tok: Tokenizer):
        self.byte_level, self.unk, self.ids = tok.byte_level, tok.unk_id, tok.ids
        self.symbols: dict[str, int] = {}
        for a, b in tok.ranks:
            for x in (a, b, a + b):
                self.symbols.setdefault(x, len(self.symbols))
        names = list(self.symbols)
        self.width = len(names) + 1
        pairs = [self.symbols[a] * self.width + self.symbols[b] for a, b in tok.ranks]
        self.rank = _Table(pairs, list(tok.ranks.values()))
        self.made = np.array([self.symbols[a + b] for a, b in sorted(tok.ranks, key=tok.ranks.get)] or [0], np.int64)
        self.base = _Table([ord(x) for x in names if len(x) == 1], [self.symbols[x] for x in names if len(x) == 1])
        self.id_of = np.array([tok.ids.get(x, tok.unk_id) for x in names] + [0], np.int64)
        self.single = _Table([ord(x) for x in tok.ids if len(x) == 1], [i for x, i in tok.ids.items() if len(x) == 1])

    def run(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.byte_level:
            raw = [w.encode() for w in pieces]
            cp = _CHARS[np.frombuffer(b"".join(raw), np.uint8)]
            size = np.array([len(w) for w in raw], np.int64)
        else:
            cp, off = _code_points(pieces)
            size = np.diff(off)
        symbol = self.base[cp]
        plain = self.single[cp]  # the id of a character that no merge touches
        ids = np.where(plain < 0, self.unk, plain)
        piece = np.repeat(np.arange(len(pieces)), size)
        far = np.iinfo(np.int64).max
        place = np.arange(len(cp))  # where a symbol stood at first; its id follows from what it became
        done = [(place[:0], symbol[:0])]
        while len(symbol):
            pair = np.where((symbol[:-1] >= 0) & (symbol[1:] >= 0) & (piece[:-1] == piece[1:]), symbol[:-1] * self.width + symbol[1:], -1)
            rank = np.append(self.rank[pair], -1)
            rank = np.where(rank < 0, far, rank)
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(piece))))
            still = least < far
            done.append((place[~still], symbol[~still]))
            hit = still & (rank == least)
            # of a run of overlapping pairs (equal symbols) every second one is made, from the left
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.append(True, np.diff(at) > 1)
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = still
            keep[at + 1] = False
            symbol, piece, place = symbol[keep], piece[keep], place[keep]
        place, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        place, symbol = place[order], symbol[order]
        out = np.where(symbol >= 0, self.id_of[symbol], ids[place])
        count = np.bincount(np.searchsorted(np.cumsum(size), place, "right"), minlength=len(pieces))
        return out.astype(np.int32), count.astype(np.int64)


def _flat(column: pa.Array):
    """(values, offsets) of a list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.append(0, np.cumsum(sizes)).astype(np.int64)


def _take(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    shift = begin - np.append(0, np.cumsum(count)[:-1]) if len(count) else begin
    return pool[np.repeat(shift, count) + np.arange(int(count.sum()))]


SLICE_PIECES = 1 << 19


def encode_batch(tok: Tokenizer, column: pa.Array, max_length: int | None) -> pa.Array:
    """Rows are taken in slices of about ``SLICE_PIECES`` pieces, so that long texts do not add up in memory."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
    parts, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_PIECES, "right")) - 1)
        parts.append(_encode_slice(tok, column.slice(lo, hi - lo), max_length))
        lo = hi
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _encode_slice(tok: Tokenizer, column: pa.Array, max_length: int | None) -> pa.Array:
    flat, off = _flat(column)
    if tok.kind == "word" and not tok.byte_level:
        ids, at = tok.word_ids(flat), off
    else:
        words = flat.dictionary_encode()
        pool, count = tok.flat_ids(words.dictionary.to_pylist())
        pool, count = np.append(pool, np.int32(tok.unk_id)).astype(np.int32), np.append(count, 1)  # the last stands for null
        which = words.indices.fill_null(len(count) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = _take(pool, (np.cumsum(count) - count)[which], count[which])
        at = np.append(0, np.cumsum(count[which]))[off]
    size = np.diff(at)
    if max_length is not None:
        size = np.minimum(size, max(0, max_length - len(tok.prefix) - len(tok.suffix)))
    body = _take(ids, at[:-1], size)
    full = size + len(tok.prefix) + len(tok.suffix)
    bounds = np.append(0, np.cumsum(full))
    out = np.empty(int(full.sum()), np.int32)
    inside = np.ones(len(out), bool)
    for k, i in enumerate(tok.prefix):
        out[bounds[:-1] + k] = i
        inside[bounds[:-1] + k] = False
    for k, i in enumerate(tok.suffix):
        place = bounds[1:] - len(tok.suffix) + k
        out[place] = i
        inside[place] = False
    out[inside] = body
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out, pa.int32()))


def encode(tok: Tokenizer, pieces, max_length: int | None = None) -> Column:
    """Pieces (array of strings) -> ids between the tokenizer's prefix and suffix, at most ``max_length``."""
    from pyspark.sql import SparkSession
    shared = SparkSession.active().sparkContext.broadcast(tok)

    def run(column: pa.Array) -> pa.Array:
        return encode_batch(shared.value, column, max_length)

    return F.arrow_udf(run, "array<int>")(pieces)


# The byte-level alphabet by its rule: printable bytes stand for themselves, the others follow from 256 in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


CHAR_OF = {b: c for c, b in BYTE_OF.items()}
_CHARS = np.array([ord(CHAR_OF[b]) for b in range(256)], np.int64)


def decode_batch(tok: Tokenizer, column: pa.Array, skip_special: bool = True) -> pa.Array:
    """The bytes of all ids of a batch are gathered in one pass; only rows of a batch that is not UTF-8 are decoded one by one."""
    flat, off = _flat(column)
    number, pool, begin, count = tok.id_bytes(skip_special)
    which = number[flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)]
    size = count[which]
    at = np.append(0, np.cumsum(size))[off]
    raw = _take(pool, begin[which], size)
    if not tok.byte_level:  # one leading blank goes
        lead = np.flatnonzero(at[1:] > at[:-1])
        lead = lead[raw[at[lead]] == 32]
        raw = np.delete(raw, at[lead])
        at = at - np.append(0, np.cumsum(np.bincount(lead, minlength=len(off) - 1)))
    data = raw.tobytes()
    starts = at[:-1][at[1:] > at[:-1]]
    try:
        data.decode()
        whole = not np.any(raw[starts] & 0xC0 == 0x80)  # no row begins inside of a character
    except UnicodeDecodeError:
        whole = False
    if whole and len(data) < 1 << 31:
        return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    bounds = at.tolist()
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])], pa.string())


def decode(tok: Tokenizer, ids, skip_special: bool = True) -> Column:
    """Ids -> text: special ids dropped; metaspace back to blanks and one leading blank removed, or bytes to UTF-8."""
    from pyspark.sql import SparkSession
    shared = SparkSession.active().sparkContext.broadcast(tok)

    def run(column: pa.Array) -> pa.Array:
        return decode_batch(shared.value, column, skip_special)

    return F.arrow_udf(run, "string")(ids)


def unknown_pieces(tok: Tokenizer, pieces) -> Column:
    """The distinct pieces of a row that need the unknown id, sorted."""
    from pyspark.sql import SparkSession
    shared = SparkSession.active().sparkContext.broadcast(tok)

    def run(column: pa.Array) -> pa.Array:
        t = shared.value
        flat, off = _flat(column)
        words = flat.dictionary_encode()
        names = words.dictionary.to_pylist()
        if t.kind == "word" and not t.byte_level:
            bad = np.append((t.word_ids(words.dictionary) == t.unk_id) & words.dictionary.is_valid().to_numpy(zero_copy_only=False), False)
        else:
            bad = np.array([w is not None and t.unk_id in t.piece_ids(w) for w in names] + [False])
        which = words.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(bad[which])
        row = np.searchsorted(off, hit, "right") - 1
        out: list = [set() for _ in range(len(off) - 1)]
        for r, w in zip(row.tolist(), which[hit].tolist()):
            out[r].add(names[w])
        return pa.array([sorted(x) for x in out], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(pieces)
