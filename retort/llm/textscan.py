"""Vectorised scans over Arrow text columns, used inside Spark tasks.

Texts are treated as UTF-8 bytes.  A *word* is a maximal run of bytes other
than space and 0x09-0x0D (all delimiters are ASCII, so byte runs equal
code-point runs).  Hashes are 64-bit polynomials of the bytes, taken from
prefix sums, so hashing every word costs a few passes over the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a folded word: all ASCII characters but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_P, _INV)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(h):
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of about ``limit`` bytes; a longer text stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end); starts and ends must both ascend."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        base, top = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(top - base + 1)
        sums = np.empty(top - base + 1, U)
        sums[0] = 0
        np.cumsum((buf[base:top].astype(U) + U(1)) * power[:top - base], out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def words(buf: np.ndarray, off: np.ndarray, delimiters: np.ndarray = _SPACE):
    """(start, end, row, hash) arrays of all words of the texts buf[off[i]:off[i + 1]].

    ``delimiters``: 256 booleans, the bytes that end a word (ASCII bytes only).
    """
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    space = delimiters[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | first[:-1]))
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends, rows, span_hashes(buf, starts, ends)


def folded_words(buf: np.ndarray, off: np.ndarray):
    """(hash, row) of the words of letters and digits, ASCII and Latin-1 letters in lower case."""
    low = _LOWER[buf]
    if len(low):
        second = low[1:]
        capital = (low[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        second[capital] += 0x20
    _, _, rows, h = words(low, off, NOT_ALNUM)
    return h, rows


def ngrams(h: np.ndarray, rows: np.ndarray, n: int):
    """Hashes and first word positions of the n-word windows inside each row."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        g = np.zeros(m, U)
        for k in range(n):
            g = g * U(0xD6E8FEB86659FD93) + h[k:k + m]
    inside = np.flatnonzero(rows[:m] == rows[n - 1:])
    return mix(g[inside]), inside


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [off[i], off[i + 1])."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def word_offsets(rows: np.ndarray, n: int) -> np.ndarray:
    """For word arrays sorted by row: offsets of each of the n rows."""
    return np.searchsorted(rows, np.arange(n + 1))
