"""Bounded-space online best-fit packing of tokenised documents.

``tokenise`` cuts each document's ids into pieces of at most ``capacity``
tokens (only longer documents are cut; the first piece takes the remainder).
``pack`` sends narrow rows, one per piece and without ids, to packers of
about ``PIECES_PER_PACKER`` pieces.  A packer places each arriving piece into
the open bin with the least sufficient free space.  Open bins are kept in a
bitset keyed by free space, so the search is a shift and a lowest-bit lookup;
at most ``OPEN_BINS`` are open, and the fullest closes first.

Ids are those of the byte-level tokenizer.  Texts are cut at single spaces
before a non-space, where the tokenizer always starts a new piece, and each
different chunk of a batch is encoded once.

Defined results: a null or empty text is one piece holding only the end id;
repeated rows are packed as separate documents; an empty table gives an empty
result; other columns are ignored; texts of any length are tokenised whole.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm import textscan as ts
from retort.llm.common import texts

CAPACITY, END_ID = 1024, 2
OPEN_BINS = 2048
PIECES_PER_PACKER = 16_384
WINDOWS = 4  # a packer's pieces arrive in so many windows, each from long to short
BATCH_BYTES = 8 << 20
SPECIAL = "<|endoftext|>"  # the vocabulary's one special token
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"
_coders: dict = {}


class Coder:
    """Encodes many texts at once; chunks that occur again are encoded once."""

    def __init__(self, tokenizer_json: str | None, ranks_file: str | None):
        import public_tokenizers as files
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file or files.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)
        self.full = Tokenizer.from_file(tokenizer_json or files.path("byte_bpe_50k.json"))

    def _cuts(self, buf, off):
        """Starts of the chunks: text starts, and spaces before a byte that cannot begin white space."""
        n = len(buf)
        at = np.flatnonzero(buf[:-1] == 0x20) if n else np.zeros(0, np.int64)
        after = buf[at + 1] if len(at) else buf[:0]
        at = at[(after > 0x20) & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))]
        first = off[:-1][off[:-1] < off[1:]]
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        inner = at[~begins[at] & ~begins[at + 1]]
        starts = np.concatenate([first, inner])
        order = np.argsort(starts, kind="stable")
        return starts[order], (np.arange(len(starts)) >= len(first))[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids)."""
        starts, spaced = self._cuts(buf, off)
        n = len(off) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        key = ts.span_hashes(buf, starts, ends)
        _, at, which = np.unique(key ^ spaced.astype(ts.U), return_index=True, return_inverse=True)
        inner = spaced[at]
        joined, sizes = gather(buf, starts[at[inner]], ends[at[inner]])
        ids = self.bpe.encode_to_numpy(joined.tobytes().decode(), disallowed_special=())
        count = np.zeros(len(at), np.int64)
        done = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes), "left") + 1
        count[inner] = np.diff(done, prepend=0)
        parts, begin = [ids], np.zeros(len(at), np.int64)
        begin[inner] = done - count[inner]
        total = len(ids)
        for i in np.flatnonzero(~inner):
            one = self.bpe.encode_ordinary(buf[starts[at[i]]:ends[at[i]]].tobytes().decode())
            parts.append(np.array(one, np.uint32))
            begin[i], count[i] = total, len(one)
            total += len(one)
        pool = np.concatenate(parts)
        out, lengths = gather(pool, begin[which], begin[which] + count[which])
        bounds = np.append(0, np.cumsum(lengths))
        return out, bounds[np.searchsorted(starts, off, "left")]

    def encode_special(self, text: str) -> np.ndarray:
        """The slow exact way, for texts that hold the special token's string."""
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of values[s:e] for all spans, and the span lengths."""
    sizes = ends - starts
    shift = starts - np.append(0, np.cumsum(sizes)[:-1]) if len(sizes) else sizes
    return values[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


def _coder(tokenizer_json, ranks_file) -> Coder:
    key = (tokenizer_json, ranks_file)
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def _with_end(coder: Coder, buf, off) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text followed by the end id."""
    ids, at = coder.encode(buf, off)
    if SPECIAL.encode() in buf.tobytes():
        each = []
        for i in range(len(off) - 1):
            raw = buf[off[i]:off[i + 1]].tobytes()
            each.append(coder.encode_special(raw.decode()) if SPECIAL.encode() in raw else ids[at[i]:at[i + 1]])
        ids = np.concatenate(each)
        at = np.append(0, np.cumsum([len(x) for x in each]))
    return np.insert(ids, at[1:], END_ID), at + np.arange(len(at))


def tokenise(docs: DataFrame, capacity: int = CAPACITY, tokenizer_json: str | None = None,
             ranks_file: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids (little-endian unsigned 32-bit).

    The two files default to the public byte-level vocabulary that is installed beside Python.
    """
    def run(batches):
        coder = _coder(tokenizer_json, ranks_file)
        for batch in batches:
            buf, off = ts.text_bytes(batch.column(1))
            for lo, hi in ts.slices(off, BATCH_BYTES):
                ids, at = _with_end(coder, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                size = np.diff(at)
                n = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = size - (n - 1) * capacity
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[row])
                bounds = np.append(0, np.cumsum(length)) * 4
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [
                    None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), raw.cast(pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return texts(docs).mapInArrow(run, PIECE_SCHEMA)


class BestFit:
    """Online best-fit with a fixed number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set while some open bin has f free places
        self.bins = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            number = self._take(f)
        else:
            if self.open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, f = self.made, self.capacity
            self.made += 1
        if f > length:
            self.bins[f - length].append(number)
            self.free |= 1 << (f - length)
            self.open += 1
        return number, self.capacity - f

    def _take(self, f: int) -> int:
        number = self.bins[f].pop()
        if not self.bins[f]:
            self.free &= ~(1 << f)
        self.open -= 1
        return number


def pack(pieces: DataFrame, packers: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (a ``length`` column and any others) with ``sequence_id`` and ``offset``.

    Pieces are dealt to packers by a hash of all their columns, so no key can
    make one packer's share large, and arrive in windows of that hash, the
    longer ones of a window first.
    """
    columns = pieces.columns
    at = columns.index("length")
    key = F.xxhash64(*columns)
    dealt = (pieces.withColumns({"__packer": F.pmod(key, F.lit(max(1, packers))),
                                 "__window": F.pmod(F.shiftright(key, 32), F.lit(WINDOWS))})
             .repartition(max(1, packers), "__packer")
             .sortWithinPartitions("__packer", "__window", F.col("length").desc(), *columns))

    def run(batches):
        now, fit = None, None
        for batch in batches:
            which = batch.column(len(columns)).to_pylist()
            sequence, offset = [], []
            for p, length in zip(which, batch.column(at).to_pylist()):
                if p != now:
                    now, fit = p, BestFit(capacity, open_bins)
                number, place = fit.place(length)
                sequence.append((p << 40) + number)
                offset.append(place)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packers_for(docs: DataFrame, per_packer: int = PIECES_PER_PACKER) -> int:
    """Packers grow with the documents; only their count is fetched."""
    return max(1, -(-docs.count() // per_packer))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Tokenise and pack: one row per piece with the checksum of its ids in place of the ids."""
    pieces = tokenise(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, packers_for(docs))
