"""Secret scans with structural confirmation.

Three base patterns (assigned values, access ids, long hex runs) are reported
as they stand.  On top of them every base64 or hex run that could hold a key
is decoded, and is reported only if its structure holds: a DER private key
whose nested lengths add up, an OpenSSH key whose length-prefixed fields fill
the blob, an armoured block with such a body, or a signed token whose header
is a JSON object that names an algorithm.  Runs that only a line break parts,
a true one or an escaped one, are joined; armour may stand in string literals.

One scan per row, no shuffle.  Spans are code points, end exclusive.

Defined results: a null text is empty and has no spans; repeated rows are
scanned row by row; an empty table gives an empty result; other columns are
ignored.  A text of any length is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from retort.llm import textscan as ts
from retort.llm.common import texts

#: Kinds in reporting order; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "key", "signed")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_BODY = re.compile(r"""(?:[A-Za-z0-9+/=\s:,."'\-]|\\+[nrt]|\\(?=\s))*+""")
_JOINT = re.compile(r"""["']\s*(?:[+.,]\s*)?["']""")  # between two string literals
_BREAK = re.compile(r"(?:[ \t]*\\?(?:\r\n?|\n)|\\+r\\+n|\\+[nr])[ \t]*")
_WRAPPED = re.compile(r"(?:(?<=\\[nr])|(?<![A-Za-z0-9+/_\-\\]))[A-Za-z0-9+/_-]{20,}={0,2}(?:" + _BREAK.pattern + r"[A-Za-z0-9+/_-]+={0,2})*")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_RUN = re.compile(r"(?:[0-9a-fA-F]{2}){24,}")
_HEX_HEAD = re.compile(r"[0-9a-fA-F]*")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_CODED = np.zeros(256, bool)
_CODED[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-"]] = True
_MIN_RUN = 20  # the shortest run any pattern without a keyword needs


def _tlv(data: bytes, at: int, end: int):
    """(tag, body start, body end) of the DER element at ``at``, or None if its length does not fit."""
    if at + 2 > end:
        return None
    size, body = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size, body = int.from_bytes(data[body:body + n], "big"), body + n
    return (data[at], body, body + size) if body + size <= end else None


def _members(data: bytes, at: int, end: int):
    """The elements that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        x = _tlv(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def der_private_key(data: bytes) -> bool:
    """A DER private key: PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA, with lengths that add up."""
    outer = _tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    inner = _members(data, outer[1], outer[2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    version = data[inner[0][1]:inner[0][2]] if tags[0] == 2 else None
    if version is not None and len(inner) >= 6 and all(t == 2 for t in tags[:6]):  # RSA or DSA numbers
        return version in (b"\0", b"\1") and all(e > s for _, s, e in inner)
    names_algorithm = lambda x: bool((m := _members(data, x[1], x[2])) and m[0][0] == 6)
    if version in (b"\0", b"\1") and len(inner) >= 3 and tags[1] == 0x30 and tags[2] == 4:
        return names_algorithm(inner[1]) and inner[2][2] > inner[2][1]
    if version == b"\1" and tags[1] == 4:
        return 16 <= inner[1][2] - inner[1][1] <= 66
    return len(inner) == 2 and tags == [0x30, 4] and names_algorithm(inner[0]) and inner[1][2] - inner[1][1] >= 32


def _der_size(data: bytes) -> int | None:
    """What the outer DER length says, header included; only the first bytes are needed."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    return None if n > 4 or data[1] == 0x80 else 2 + n + (int.from_bytes(data[2:2 + n], "big") if n else data[1])


def _openssh_size(data: bytes) -> int | None:
    """Size of the OpenSSH container at the start: magic, three strings, a key count, public keys and one private blob."""
    magic, at = b"openssh-key-v1\0", 15
    if not data.startswith(magic):
        return None

    def field(at):
        n = int.from_bytes(data[at:at + 4], "big")
        return at + 4 + n if at + 4 <= len(data) and at + 4 + n <= len(data) else None

    for _ in range(3):
        at = field(at)
        if at is None:
            return None
    count, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return None
    for _ in range(count + 1):
        at = field(at)
        if at is None:
            return None
    return at


def openssh_private_key(data: bytes) -> bool:
    """An OpenSSH container that ends with the data."""
    return _openssh_size(data) == len(data)


def _decode64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def holds_key(data: bytes | None) -> bool:
    if not data or len(data) < 24:
        return False
    if data.startswith(b"-----BEGIN "):
        return next(_armoured(data.decode("latin-1")), None) is not None
    return der_private_key(data) or openssh_private_key(data)


def _armoured(text: str):
    """(start, end) of the armoured keys: an END line belongs to the nearest mark before it, if that is its BEGIN line, so bodies never overlap."""
    begin = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin is not None and begin[2] == m[2] and _BODY.fullmatch(text, begin.end(), m.start()) and _armour_holds_key(text[begin.end():m.start()]):
            yield begin.start(), m.end()
        begin = None


def _armour_holds_key(body: str) -> bool:
    text = _JOINT.sub("\n", re.sub(r"\\+[nrt]|\\(?=\s)", "\n", body))
    lines = "".join(x for x in text.splitlines() if ":" not in x and "," not in x)
    data = _decode64("".join(lines.split()))
    encrypted = "ENCRYPTED" in body
    return data is not None and (holds_key(data) or encrypted and len(data) >= 32 and len(data) % 8 == 0)


def _unhex(run: str) -> bytes | None:
    try:
        return binascii.unhexlify(run[:len(run) // 2 * 2])
    except binascii.Error:
        return None


def _wrapped(body: str) -> list[tuple[int, int]]:
    """Spans of the keys in a chain of runs that only line breaks part: from a line that begins as a key does, as many lines as its own lengths say."""
    lines, at = [], 0
    for m in _BREAK.finditer(body):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(body)))
    runs = [body[a:b].rstrip("=") for a, b in lines]
    out, i = [], 0
    while i < len(lines):
        for starts, magic, decode, bits in ((("M",), "b3BlbnNzaC1rZXkt", _decode64, 6), (("30",), "6f70656e7373682d6b6579", _unhex, 4)):
            size = None
            if runs[i].startswith(starts):
                size = _der_size(decode(runs[i][:16]) or b"")
            elif runs[i].lower().startswith(magic.lower()):
                rest = "".join(runs[i:])
                rest = rest[:len(rest) - (len(rest) % 4 == 1)] if bits == 6 else _HEX_HEAD.match(rest)[0]
                size = _openssh_size(decode(rest) or b"")
            if size is None:
                continue
            need, j = -(-size * 8 // bits), i
            while need > 0 and j < len(runs):
                need -= len(runs[j])
                j += 1
            run = "".join(runs[i:j])
            if not need and holds_key(_decode64(run) if bits == 6 else _unhex(run)):
                out.append((lines[i][0], lines[j - 1][1]))
                i = j - 1
                break
        i += 1
    return out


def signed_token(header: str, payload: str) -> bool:
    """The header names an algorithm and the payload decodes to a JSON object too."""
    try:
        h, p = json.loads(_decode64(header) or b""), json.loads(_decode64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def _signed_tokens(text: str):
    """(start, end) of signed tokens: any three neighbours of a dotted chain, so that a name before the header hides nothing."""
    for m in _DOTTED.finditer(text):
        parts, at, free = m[0].split("."), m.start(), 0
        for i, part in enumerate(parts[:-2]):
            if i >= free and len(part) >= 12 and len(parts[i + 1]) >= 2 and signed_token(part, parts[i + 1]):
                yield at, at + len(part) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                free = i + 3
            at += len(part) + 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every secret, in that order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    held = list(_armoured(text))

    def apart(at: int) -> bool:
        i = bisect.bisect_right(held, (at, len(text))) - 1
        return i < 0 or at >= held[i][1]

    keys = list(held)
    for m in _RUN.finditer(text):
        if apart(m.start()) and holds_key(_decode64(m[0])):
            keys.append((m.start(), m.end()))
    for m in _WRAPPED.finditer(text):
        keys += [(m.start() + a, m.start() + b) for a, b in _wrapped(m[0]) if apart(m.start() + a)]
    for m in _HEX_RUN.finditer(text):
        if holds_key(bytes.fromhex(m[0])):
            keys.append((m.start(), m.end()))
    out += [(s, 3, e) for s, e in keys]
    out += [(s, 4, e) for s, e in _signed_tokens(text)]
    return sorted(set(out))


def _may_hold(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that can hold any secret: those with a keyword or a long run of coded characters."""
    n = len(off) - 1
    coded = np.zeros(len(buf) + 2, np.int8)
    coded[1:-1] = _CODED[buf]
    edge = np.diff(coded)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = starts[ends - starts >= _MIN_RUN]  # a run over the border of two texts only adds a row to look at
    out = np.zeros(n, bool)
    stops = ends[ends - starts >= _MIN_RUN] - 1
    for at in (long, stops):
        out[np.searchsorted(off, at, "right") - 1] = True
    for lo, hi in zip(np.searchsorted(off, long, "right") - 1, np.searchsorted(off, stops, "right")):
        out[lo:hi] = True
    for i in np.flatnonzero(~out):
        low = buf[off[i]:off[i + 1]].tobytes().lower()
        out[i] = any(w in low for w in _WORDS)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (start, kind, end) structs."""
    def run(batches):
        kinds = pa.array(KINDS)
        for batch in batches:
            buf, off = ts.text_bytes(batch.column(1))
            counts, found = np.zeros(len(off), np.int32), []
            for lo, hi in ts.slices(off):
                for i in lo + np.flatnonzero(_may_hold(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])):
                    spans = find(buf[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"))
                    counts[i + 1] = len(spans)
                    found += spans
            starts, which, ends = zip(*found) if found else ((), (), ())
            items = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), kinds.take(pa.array(which, pa.int32())), pa.array(ends, pa.int64())],
                names=["start", "kind", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), items)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def without_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans become one.

    All columns stay; a null text stays null, a text without secrets stays as it is.
    """
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            buf, off = ts.text_bytes(batch.column(at))
            changed = {}
            for lo, hi in ts.slices(off):
                for i in lo + np.flatnonzero(_may_hold(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])):
                    text = buf[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace")
                    if spans := find(text):
                        changed[int(i)] = redact(text, spans, mark)
            if changed:
                values = batch.column(at).to_pylist()
                for i, text in changed.items():
                    values[i] = text
                new = pa.array(values, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)],
                                                   schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s > end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:s])
        end = max(end, e)
    return "".join([*out, mark, text[end:]])


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
