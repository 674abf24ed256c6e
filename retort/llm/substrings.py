"""Suffix-array dedup: maximal repeats from common-prefix interval trees.

Every ``LENGTH``-byte string that also starts in a document with a smaller
doc_id is removed; strings are judged on the input, and matches never cross
documents.

*Anchors.*  Sorting every suffix of the corpus would shuffle many times its
size, so suffixes are met at anchors: the anchor of a window of ``LENGTH``
bytes is the place in it of the ``GRAM``-byte string with the least hash.
Equal windows have it at the same distance, hence all occurrences of a string
meet under one anchor hash, whatever documents they are in.  Consecutive
windows with one anchor make a *span*.

*Rounds.*  Documents are dealt once into blocks of about ``BLOCK_BYTES``;
all rounds read that one exchange.  (1) Each block sends its anchor hashes,
once for each different span; a bucket of hashes replies which occur again.
(2) Blocks send the bytes of those spans, each different one once with its
smallest doc_id, and a bucket builds the suffix array of the spans that meet
there with its common-prefix lengths, scans it with a stack into the interval
tree, and keeps the intervals whose members differ in the byte to their left
(a span's border differs from everything): the maximal repeats, each with all
its members.  (3) Blocks get back which bytes of their spans a smaller
document holds.

*Hot groups.*  Equal texts are settled before the rounds (all but the one of
smallest doc_id lose all of a text of ``LENGTH`` bytes or more), and a block
sends a span once however often it occurs.  An anchor hash with more than
``HOT`` different spans is replaced by its single windows, which scatter.

Defined results: a null text is empty; texts shorter than ``LENGTH`` stay; a
null doc_id is larger than any other; rows with equal doc_id (repeated rows)
do not remove each other's bytes; an empty table gives an empty result; other
columns are ignored; texts of any length are treated whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm import textscan as ts
from retort.llm.common import text_key, texts
from retort.session import checkpoint_dir

LENGTH, GRAM = 50, 16
BLOCK_BYTES = 4 << 20
BUCKET_ANCHORS = 1 << 16  # anchor hashes a bucket is sized for
ANCHORS_PER_BYTE = 0.058
HOT = 10_000
_PIECE = (1 << 17) - 128
_PLACE = (1 << 17) - 1
_LAST_ID = np.iinfo(np.int64).max
_MEMBERS = 1 << 18
_MASK = 88  # bits: more than the bytes of any span (LENGTH - 1 + windows of one anchor)


def anchors(buf: np.ndarray, off: np.ndarray):
    """(first window, windows, place, hash) of the anchors of texts buf[off[i]:off[i + 1]]."""
    span = LENGTH - GRAM + 1
    power, inverse = ts._power_tables(_PIECE + LENGTH + 1)
    edge = np.zeros(len(buf) + 1, np.int32)  # windows that would leave their text are closed
    np.add.at(edge, np.maximum(off[:-1], off[1:] - LENGTH + 1), 1)
    np.add.at(edge, off[1:], -1)
    closed = np.cumsum(edge, dtype=np.int32)[:-1] > 0
    out = []
    for s in range(0, len(buf) - LENGTH + 1, _PIECE):
        part = buf[s:s + _PIECE + LENGTH - 1]
        n = len(part) - LENGTH + 1
        sums = np.zeros(len(part) + 1, ts.U)
        np.cumsum((part.astype(ts.U) + ts.U(1)) * power[:len(part)], out=sums[1:])
        h = ts.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(part) - GRAM + 1])
        low = (h & ~ts.U(_PLACE)) | np.arange(len(h), dtype=ts.U)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width:span - width + n])
        place = (low & ts.U(_PLACE)).astype(np.int64)
        ok = ~closed[s:s + n]
        new, last = ok.copy(), ok.copy()
        turn = place[1:] != place[:-1]
        new[1:] &= turn | ~ok[:-1]
        last[:-1] &= turn | ~ok[1:]
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        p = place[a]
        out.append((a + s, b - a + 1, p + s, h[p]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, ts.U)
    return tuple(np.concatenate(x) for x in zip(*out))


class Layout:
    """How many blocks and buckets (a power of two) a corpus of so many bytes is dealt into.

    Buckets multiply with the corpus, so none grows with it.  Where a block has
    less than one hash for a bucket, a hash costs a row (about 40 bytes).
    """

    def __init__(self, total_bytes: int, block_bytes: int = BLOCK_BYTES, bucket_anchors: int = BUCKET_ANCHORS,
                 hot: int = HOT):
        self.hot = hot
        self.blocks = max(1, -(-total_bytes // block_bytes))
        need = total_bytes * ANCHORS_PER_BYTE / bucket_anchors
        self.bits = max(0, int(np.ceil(np.log2(max(1.0, need)))))

    def trim(self, h: np.ndarray) -> np.ndarray:
        """Hashes keep the bits of the bucket and 48 more, as far as they have them."""
        return h & ~ts.U((1 << max(0, 16 - self.bits)) - 1)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> ts.U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def pack(self, h: np.ndarray) -> np.ndarray:
        """The 48 bits below the bucket's (past 16 bits of buckets all that are left, then zeros), as n x 6 bytes."""
        return ((h << ts.U(self.bits)) >> ts.U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]

    def cuts(self, h: np.ndarray):
        """(bucket, from, to) of the buckets present in sorted hashes."""
        b = self.bucket(h)
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        return list(zip(b[at].tolist(), at.tolist(), np.append(at[1:], len(b)).tolist()))


def _unpack(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


class Block:
    """One block's documents in doc_id order, without copies of texts of smaller documents."""

    def __init__(self, t: pa.Table, layout: Layout):
        self.layout = layout
        flagged = t.filter(t.column("copy"))
        t = t.filter(pc.invert(t.column("copy")))
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("key", "ascending")]))
        copies = set(zip(flagged.column("doc_id").to_pylist(), flagged.column("key").to_pylist()))
        self.table = t
        self.is_copy = np.array([x in copies for x in zip(t.column("doc_id").to_pylist(), t.column("key").to_pylist())], bool)
        own = t.filter(pa.array(~self.is_copy)) if t.num_rows else t
        self.ids = pc.fill_null(own.column("doc_id"), _LAST_ID).combine_chunks().to_numpy(zero_copy_only=False)
        self.buf, self.off = ts.text_bytes(own.column("text"))

    def anchors(self):
        self.start, self.count, self.place, h = anchors(self.buf, self.off)
        self.hash = self.layout.trim(h)
        self._spans(np.zeros(len(h), bool))

    def _spans(self, single: np.ndarray) -> None:
        """End, document and hash (of bytes and shape) of every span; single windows lie inside hot spans."""
        self.end = self.start + self.count + LENGTH - 1
        self.doc = self.ids[np.searchsorted(self.off, self.start, "right") - 1]
        h = np.zeros(len(self.start), ts.U)
        for part in (single, ~single):  # each list ascends
            h[part] = ts.span_hashes(self.buf, self.start[part], self.end[part])
        self.span = ts.mix(h + (self.place - self.start).astype(ts.U) * ts.U(0x9E3779B97F4A7C15))

    def hashes(self) -> np.ndarray:
        """Sorted hashes: one for each different span, and at least two where several documents share it."""
        self.anchors()
        order = np.lexsort((self.span, self.hash))
        h, g, d = self.hash[order], self.span[order], self.doc[order]
        if not len(h):
            return h
        new = np.append(True, h[1:] != h[:-1])
        first = np.flatnonzero(new)
        spans = np.add.reduceat((new | np.append(True, g[1:] != g[:-1])).astype(np.int64), first)
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        return np.repeat(h[first], np.maximum(spans, 1 + several))

    def choose(self, replies: dict[int, bytes]) -> None:
        """Keep the anchors whose hash occurs again; hot ones become single windows."""
        self.anchors()
        u, which = np.unique(self.hash, return_inverse=True)
        again, hot = np.zeros(len(u), bool), np.zeros(len(u), bool)
        for b, lo, hi in self.layout.cuts(u):
            bits = np.unpackbits(np.frombuffer(replies[b], np.uint8))
            half = len(bits) // 2
            again[lo:hi], hot[lo:hi] = bits[:hi - lo], bits[half:half + hi - lo]
        again, hot = again[which], hot[which]
        keep = again & ~hot
        count = self.count[hot]
        windows = np.repeat(self.start[hot] - np.append(0, np.cumsum(count)[:-1])[:len(count)], count) + np.arange(count.sum())
        start = np.concatenate([self.start[keep], windows])
        order = np.argsort(start, kind="stable")
        window_hash = self.layout.trim(ts.span_hashes(self.buf, windows, windows + LENGTH))
        pick = lambda a, b: np.concatenate([a[keep], b])[order]
        single = np.append(np.zeros(int(keep.sum()), bool), np.ones(len(windows), bool))[order]
        self.hash = pick(self.hash, window_hash)
        self.count = pick(self.count, np.ones(len(windows), np.int64))
        self.place = pick(self.place, windows)
        self.start = start[order]
        self._spans(single)
        order = np.lexsort((self.doc, self.span, self.hash))
        new = np.ones(len(order), bool)
        new[1:] = (self.hash[order][1:] != self.hash[order][:-1]) | (self.span[order][1:] != self.span[order][:-1])
        self.entry = np.empty(len(order), np.int64)  # each anchor's number among the different spans
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[new]  # an occurrence of each different span in its smallest document

    def marked(self, replies: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        """Bytes to remove, given each bucket's codes (0 nothing, 1 whole span, 2 masked) and masks."""
        code = np.zeros(len(self.first), np.uint8)
        masks = np.zeros((len(self.first), _MASK // 8), np.uint8)
        for b, lo, hi in self.layout.cuts(self.hash[self.first]):
            codes, bits = replies[b]
            code[lo:hi] = np.frombuffer(codes, np.uint8)
            masks[lo + np.flatnonzero(code[lo:hi] == 2)] = np.frombuffer(bits, np.uint8).reshape(-1, _MASK // 8)
        smallest = self.doc[self.first][self.entry]
        whole = (code[self.entry] == 1) | (self.doc > smallest)
        edge = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(edge, self.start[whole], 1)
        np.add.at(edge, self.end[whole], -1)
        out = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        part = np.flatnonzero(~whole & (code[self.entry] == 2))
        for a in range(0, len(part), 1 << 14):
            own = part[a:a + (1 << 14)]
            row, bit = np.nonzero(np.unpackbits(masks[self.entry[own]], axis=1))
            out[self.start[own][row] + bit] = True
        return out


def _rows(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


_REPLY = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("head", pa.binary()),
                    ("body", pa.binary())])
_REPLY_SQL = "block long, kind int, bucket long, head binary, body binary"


def _send_hashes(layout: Layout):
    def run(t: pa.Table) -> pa.Table:
        h = Block(t, layout).hashes()
        cuts = layout.cuts(h)
        raw = layout.pack(h)
        n = len(cuts)
        return _rows({"block": [t.column("block")[0].as_py()] * n, "kind": [0] * n, "bucket": [b for b, _, _ in cuts],
                      "head": [raw[lo:hi].tobytes() for _, lo, hi in cuts], "body": [None] * n}, _REPLY)
    return run


def _which_again(layout: Layout):
    """For each block the hashes that occur again in the corpus, and those that are hot, as bits."""
    def run(t: pa.Table) -> pa.Table:
        lists = [_unpack(np.frombuffer(x, np.uint8)) for x in t.column("head").to_pylist()]
        every, count = np.unique(np.concatenate(lists), return_counts=True)
        out = []
        for h in lists:
            own = h[np.append(True, h[1:] != h[:-1])]
            n = count[np.searchsorted(every, own)]
            out.append(np.packbits(n > 1).tobytes() + np.packbits(n > layout.hot).tobytes())
        return _rows({"block": t.column("block").to_pylist(), "kind": [0] * len(out),
                      "bucket": t.column("bucket").to_pylist(), "head": out, "body": [None] * len(out)}, _REPLY)
    return run


def _replies(t: pa.Table, kind: int) -> dict:
    own = t.filter(pc.equal(t.column("kind"), kind))
    return dict(zip(own.column("bucket").to_pylist(), zip(own.column("head").to_pylist(), own.column("body").to_pylist())))


def _send_spans(layout: Layout):
    """A row for each bucket: hashes, shapes and smallest documents of the spans, and their bytes."""
    from retort.llm.packing import gather

    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _REPLY.empty_table()
        x = Block(t, layout)
        x.choose({b: head for b, (head, _) in _replies(replies, 0).items()})
        f = x.first
        h, raw = x.hash[f], layout.pack(x.hash[f])
        cuts = layout.cuts(h)
        head, body = [], []
        for _, lo, hi in cuts:
            own = f[lo:hi]
            shape = np.stack([x.place[own] - x.start[own], x.end[own] - x.start[own]]).astype(np.uint8)
            head.append(raw[lo:hi].tobytes() + shape.tobytes() + x.doc[own].astype("<i8").tobytes())
            spans, _ = gather(x.buf, x.start[own], x.end[own])
            body.append(len(spans).to_bytes(8, "little") + pa.compress(spans.tobytes(), "zstd", asbytes=True))
        n = len(cuts)
        return _rows({"block": [t.column("block")[0].as_py()] * n, "kind": [1] * n, "bucket": [b for b, _, _ in cuts],
                      "head": head, "body": body}, _REPLY)
    return run


class Repeats:
    """Maximal repeats among texts ``buf[start:end]``: groups (length, from, to) over sorted suffixes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        count = end - start - LENGTH + 1
        self.owner = np.repeat(np.arange(len(start)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        suffix = start[self.owner] + at
        # a suffix whose first LENGTH bytes occur once is in no interval
        _, which, often = np.unique(ts.span_hashes(buf, suffix, suffix + LENGTH), return_inverse=True, return_counts=True)
        keep = often[which] > 1
        self.owner, self.at, suffix = self.owner[keep], at[keep], suffix[keep]
        size = end[self.owner] - suffix
        words = self._words(buf, suffix, size)
        order = np.lexsort(words[::-1])
        self.owner, self.at, suffix, size = self.owner[order], self.at[order], suffix[order], size[order]
        words = [w[order] for w in words]
        common = self._common(words, size)
        del words
        self.length, self.lo, self.hi = self._intervals(common)
        left = np.where(self.at > 0, buf[suffix - 1].astype(np.int64), -1 - np.arange(len(suffix))) if len(suffix) else suffix
        turns = np.append(0, np.cumsum(left[1:] != left[:-1]))
        diverse = turns[self.hi] > turns[self.lo]
        self.length, self.lo, self.hi = self.length[diverse], self.lo[diverse], self.hi[diverse]

    @staticmethod
    def _words(buf, suffix, size):
        """The suffixes as big-endian words, zero after their end."""
        padded = np.append(buf, np.zeros(_MASK + 8, np.uint8))
        n = len(buf) + _MASK
        eight = np.zeros(n, ts.U)
        for k in range(8):
            eight = (eight << ts.U(8)) | padded[k:k + n]
        out = []
        for j in range(0, _MASK, 8):
            valid = np.clip(size - j, 0, 8)
            shift = ((8 - valid) * 8).astype(ts.U)
            w = eight[np.minimum(suffix + j, n - 1)]
            out.append(np.where(valid > 0, (w >> np.minimum(shift, ts.U(63))) << np.minimum(shift, ts.U(63)), ts.U(0)))
        return out

    @staticmethod
    def _common(words, size):
        """Common prefix lengths of neighbours."""
        n = max(0, len(size) - 1)
        common, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for w in words:
            x = w[1:] ^ w[:-1]
            equal = np.full(n, 8)
            for k in range(8):
                equal[(x >> ts.U(56 - 8 * k)) != 0] = np.minimum(equal, k)[(x >> ts.U(56 - 8 * k)) != 0]
            common += np.where(open_, equal, 0)
            open_ &= x == 0
        return np.minimum(common, np.minimum(size[1:], size[:-1])) if n else common

    @staticmethod
    def _intervals(common):
        """The interval tree's nodes of LENGTH or more, by one scan with a stack."""
        length, lo, hi = [], [], []
        stack: list[tuple[int, int]] = []
        for i, c in enumerate(common.tolist() + [0]):
            begin = i
            while stack and stack[-1][0] > c:
                n, begin = stack.pop()
                length.append(n)
                lo.append(begin)
                hi.append(i)
            if c >= LENGTH and (not stack or stack[-1][0] < c):
                stack.append((c, begin))
        return np.array(length, np.int64), np.array(lo, np.int64), np.array(hi, np.int64)


def _meet(t: pa.Table):
    """The spans of one bucket: block row, hash, shape, document, and their bytes."""
    row, h, shape, doc, body = [], [], [], [], []
    for k, (head, packed) in enumerate(zip(t.column("head").to_pylist(), t.column("body").to_pylist())):
        raw = np.frombuffer(head, np.uint8)
        n = len(raw) // 16
        row.append(np.full(n, k))
        h.append(_unpack(raw[:6 * n]))
        shape.append(raw[6 * n:8 * n].reshape(2, n))
        doc.append(raw[8 * n:].view("<i8"))
        body.append(np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), np.uint8))
    place, size = np.concatenate(shape, axis=1).astype(np.int64)
    return np.concatenate(row), np.concatenate(h), place, size, np.concatenate(doc), np.concatenate(body)


def _judge(t: pa.Table) -> pa.Table:
    """For each block the codes and masks of its spans: which bytes a smaller document holds."""
    from retort.llm.packing import gather

    row, h, place, size, doc, buf = _meet(t)
    end = np.cumsum(size)
    start = end - size
    g = ts.span_hashes(buf, start, end) + place.astype(ts.U)
    order = np.lexsort((doc, g, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]  # each different span, in its smallest document
    u, which, spans = np.unique(h[first], return_inverse=True, return_counts=True)
    many = np.flatnonzero(spans[which] > 1)  # a hash with one span is one repeat: the span
    code = (doc > doc[first][kind]).astype(np.uint8)
    masks = np.zeros((len(first), _MASK // 8), np.uint8)
    if len(many):
        own, sizes = gather(buf, start[first[many]], end[first[many]])
        stop = np.cumsum(sizes)
        r = Repeats(own, stop - sizes, stop)
        least = doc[first[many]]
        if len(r.length):
            by_suffix = np.append(least[r.owner], _LAST_ID)
            holder = np.minimum.reduceat(by_suffix, np.stack([r.lo, r.hi + 1], 1).ravel())[::2]
            edge = np.zeros((len(many), _MASK + 1), np.int32)
            size = r.hi - r.lo + 1
            whole = np.append(0, np.cumsum(size))
            a = 0
            while a < len(size):  # as many groups at a time as have about _MEMBERS members
                b = max(a + 1, int(np.searchsorted(whole, whole[a] + _MEMBERS, "right")) - 1)
                lo, n = r.lo[a:b], size[a:b]
                member = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                node = a + np.repeat(np.arange(len(n)), n)
                held = holder[node] < by_suffix[member]
                member, node = member[held], node[held]
                np.add.at(edge, (r.owner[member], r.at[member]), 1)
                np.add.at(edge, (r.owner[member], r.at[member] + r.length[node]), -1)
                a = b
            masks[many] = np.packbits(np.cumsum(edge, axis=1, dtype=np.int32)[:, :_MASK] > 0, axis=1)
    partly = masks.any(axis=1)[kind] & (code == 0)
    code[partly] = 2
    cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
    head, body = [], []
    for a, b in zip(cut[:-1], cut[1:]):
        head.append(code[a:b].tobytes())
        body.append(masks[kind[a:b][code[a:b] == 2]].tobytes())
    return _rows({"block": t.column("block").to_pylist(), "kind": [1] * len(head), "bucket": t.column("bucket").to_pylist(),
                  "head": head, "body": body}, _REPLY)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_OUT_SQL = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def _remove(layout: Layout):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _OUT.empty_table()
        x = Block(t, layout)
        x.choose({b: head for b, (head, _) in _replies(replies, 0).items()})
        gone = x.marked(_replies(replies, 1))
        buf, off = ts.text_bytes(x.table.column("text"))
        size = np.diff(off)
        every = np.zeros(len(buf), bool)
        every[np.repeat(~x.is_copy, size)] = gone
        every |= np.repeat(x.is_copy & (size >= LENGTH), size)
        begins = np.zeros(len(buf) + 1, bool)
        begins[off] = True
        starts = np.flatnonzero(every & np.append(True, ~every[:-1] | begins[1:-1])) if len(buf) else off[:0]
        ends = np.flatnonzero(every & np.append(~every[1:] | begins[1:-1], True)) + 1 if len(buf) else off[:0]
        row = np.searchsorted(off, starts, "right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(row, np.arange(len(off))).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(starts - off[row]), pa.array(ends - off[row])], names=["start", "end"]))
        left = np.append(0, np.cumsum(~every))[off]
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(size), [
            None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(buf[~every].tobytes())])
        ids = x.table.column("doc_id").combine_chunks()
        return pa.table([ids, pa.array(size), spans, kept], schema=_OUT)
    return run


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, key and size of every text, written once: sizes the layout and finds copies."""
    checkpoint_dir(docs.sparkSession)
    return texts(docs).select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length("text").alias("n")).checkpoint()


def _blocks(docs: DataFrame, narrow: DataFrame, layout: Layout) -> DataFrame:
    """Texts by block, and a row without text for every copy of a text of a smaller document."""
    t = texts(docs).withColumn("key", text_key(F.col("text")))
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(layout.blocks)).alias("block")
    least = (narrow.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("key", "least").checkpoint())  # written, so that Spark can split the join's hot keys
    copies = (narrow.join(least, "key").where((F.col("doc_id") > F.col("least")) | F.col("doc_id").isNull() & F.col("least").isNotNull())
              .select(block, "doc_id", F.lit(None).cast("binary").alias("text"), "key", F.lit(True).alias("copy")))
    return (t.select(block, "doc_id", F.col("text").cast("binary").alias("text"), "key", F.lit(False).alias("copy"))
            .unionByName(copies))


def dedup(docs: DataFrame, **sizes) -> DataFrame:
    """One row per input row: doc_id, n_bytes, ``removed`` (maximal runs, in bytes) and ``kept`` (the other bytes).

    ``sizes``: options of ``Layout``.
    """
    narrow = _narrow(docs)
    total = narrow.agg(F.sum("n").alias("n")).first()["n"] or 0
    layout = Layout(int(total), **sizes)
    blocks = _blocks(docs, narrow, layout)
    again = blocks.groupBy("block").applyInArrow(_send_hashes(layout), _REPLY_SQL).groupBy("bucket").applyInArrow(
        _which_again(layout), _REPLY_SQL)
    spans = blocks.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_send_spans(layout), _REPLY_SQL)
    judged = spans.groupBy("bucket").applyInArrow(_judge, _REPLY_SQL)
    return (blocks.groupBy("block").cogroup(again.unionByName(judged).groupBy("block"))
            .applyInArrow(_remove(layout), _OUT_SQL))
