"""WARC archives compressed with Zstandard: written by tasks, read back record by record.

An archive (``.warc.zst``) begins with a skippable frame that holds a
compression dictionary (itself compressed or not); then every record is one
frame.  The reader loads the dictionary, finds each frame's end from its
block sizes, decodes one frame at a time and checks the record: version line,
required headers, the stated length against the block, the closing line ends,
the digests, the HTTP length, the target of a revisit.  A record that fails is
returned with what is wrong in ``problem``; bytes that are no frame end the
archive with one such row.

Writing: equal payloads of at least ``least`` bytes are stored once, by the
page of the smallest id (``response``); the others become ``revisit`` records
that name it.  Every task trains a dictionary on the first records it gets (at
most ``SAMPLE_BYTES``; only the compression depends on it) and writes archives
of about ``ARCHIVE_BYTES``, first under a hidden name.  The names of finished
archives are written by Spark as a manifest, which only holds what committed
tasks wrote; files of lost attempts are removed afterwards.  Tasks write
through Arrow's file systems, so the folder may be a shared file system, HDFS
or an object store; reading uses Spark's ``binaryFile``.

Defined results: null html is an empty payload; null urls have no header, and
control characters in urls are written in percent form; repeated rows become
records of their own (all rows of the smallest id are responses); a null
page_id is later than any other; an empty table writes no archive and reads as
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retort.session import checkpoint_dir, drop_path, stage_path

LEAST = 100
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, SAMPLES = 8 << 20, 1 << 20, 32 << 10, 8
LARGEST = (1 << 31) - 1
DATE = "2024-01-01T00:00:00Z"

# Magic numbers of the Zstandard format and the skippable frame of a WARC dictionary.
FRAME, SKIPPABLE, DICT_FRAME = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = T.StructType([T.StructField(n, t) for n, t in (
    ("archive", T.StringType()), ("place", T.LongType()), ("page_id", T.LongType()), ("url", T.StringType()),
    ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()),
    ("refers_to", T.LongType()), ("html", T.StringType()), ("problem", T.StringType()))])


# ------------------------------------------------------------------ records

def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers,
             ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return "urn:page:" + ("unknown:" + uuid.uuid4().hex if page_id is None else str(page_id))


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                date: str = DATE) -> bytes:
    """A response with its payload, or a revisit that has only the HTTP head."""
    headers = [("WARC-Payload-Digest", "sha256:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", _urn(page_id), headers, http + payload, date)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_urn(refers_to)}>")]
    return _record("revisit", _urn(page_id), headers, http, date)


class Problem(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise Problem(what)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        _need(bool(colon and name.strip()), f"malformed header {line[:40]!r}")
        out[name.strip().lower()] = value.strip(" \t")
    return out


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    _need(value.isascii() and value.isdigit(), f"{what} has no valid Content-Length")
    return int(value)


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def parse_record(raw: bytes) -> dict:
    """The fields of a record; raises ``Problem`` where it breaks a rule."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    _need(re.fullmatch(rb"WARC/1\.[01]", version) is not None, "no WARC version line")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date"):
        _need(bool(h.get(name)), f"no {name} header")
    size = _length(h, "record")
    _need(len(rest) == size + 4, f"Content-Length {size}, but the block has {max(0, len(rest) - 4)} bytes")
    _need(rest.endswith(b"\r\n\r\n"), "no line ends after the block")
    block = rest[:-4]
    if h.get("warc-block-digest", "").startswith("sha256:"):
        _need(h["warc-block-digest"][7:] == hashlib.sha256(block).hexdigest(), "block digest differs")
    out = {"page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"]}
    if h["warc-type"] not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    _need(bool(gap) and status.startswith(b"HTTP/"), "no HTTP head")
    digest = h.get("warc-payload-digest", "")
    _need(digest.startswith("sha256:"), "no SHA-256 payload digest")
    out |= {"payload_bytes": _length(_headers(lines), "HTTP head"), "payload_digest": digest[7:]}
    if h["warc-type"] == "revisit":
        _need(bool(h.get("warc-refers-to")) and not payload, "a revisit needs WARC-Refers-To and no payload")
        return out | {"refers_to": _page(h["warc-refers-to"])}
    _need(len(payload) == out["payload_bytes"], "HTTP Content-Length differs from the payload")
    _need(hashlib.sha256(payload).hexdigest() == out["payload_digest"], "payload digest differs")
    return out | {"payload": payload}


# ------------------------------------------------------------------ frames

def frame_end(buf, at: int) -> tuple[int, int]:
    """(end of the frame at ``at``, its magic number), from its header and block sizes."""
    import zstandard
    magic = int.from_bytes(buf[at:at + 4], "little")
    if magic & ~15 == SKIPPABLE:
        _need(at + 8 <= len(buf), "truncated frame")
        end = at + 8 + int.from_bytes(buf[at + 4:at + 8], "little")
    else:
        _need(magic == FRAME, "no Zstandard frame")
        try:
            params, end = zstandard.get_frame_parameters(buf[at:at + 18]), at + zstandard.frame_header_size(buf[at:at + 18])
        except zstandard.ZstdError as e:
            raise Problem("truncated frame") from e
        last = False
        while not last:
            _need(end + 3 <= len(buf), "truncated frame")
            block = int.from_bytes(buf[end:end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            _need(kind != 3, "reserved block type")
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * params.has_checksum
    _need(end <= len(buf), "truncated frame")
    return end, magic


def _decode(reader, frame: bytes) -> bytes:
    import zstandard
    try:
        size = zstandard.get_frame_parameters(frame).content_size
        known = size != zstandard.CONTENTSIZE_UNKNOWN
        _need(not known or size <= LARGEST, "record too large")
        if not known or not size:
            return reader.decompressobj().decompress(frame)
        return reader.decompress(frame)
    except zstandard.ZstdError as e:
        raise Problem(f"frame cannot be decoded: {e}"[:200]) from e


def records(buf):
    """The records of an archive one after the other, as dicts; a broken one has only ``problem``."""
    import zstandard
    reader, at, first = zstandard.ZstdDecompressor(), 0, True
    while at < len(buf):
        try:
            end, magic = frame_end(buf, at)
        except Problem as e:
            yield {"problem": str(e)}
            return
        frame = bytes(buf[at:end])
        at = end
        if magic != FRAME:
            if first and magic == DICT_FRAME:
                words = frame[8:]
                try:
                    if words[:4] == FRAME.to_bytes(4, "little"):
                        words = _decode(zstandard.ZstdDecompressor(), words)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
                except (Problem, zstandard.ZstdError) as e:
                    yield {"problem": f"dictionary: {e}"[:200]}
            first = False
            continue
        first = False
        try:
            yield parse_record(_decode(reader, frame))
        except Problem as e:
            yield {"problem": str(e)}


# ------------------------------------------------------------------ writing

class _Archives:
    """The archives of one task: rolled at ``size`` bytes, visible under their names only when complete."""

    def __init__(self, folder: str, size: int, date: str):
        from pyarrow import fs
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.size, self.date, self.name, self.done = size, date, "", []
        self.held, self.weight, self.compressor, self.dictionary = [], 0, None, None

    def add(self, record: bytes) -> None:
        if self.compressor:
            self._put(record)
            return
        self.held.append(record)
        self.weight += len(record)
        if self.weight >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        """Train the dictionary on the records held; too few of them, and there is none."""
        import zstandard
        try:
            if len(self.held) >= SAMPLES:
                d = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, self.weight // 8)), self.held)
                self.dictionary = d.as_bytes()
        except zstandard.ZstdError:
            self.dictionary = None
        known = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **known)
        held, self.held = self.held, []
        for r in held:
            self._put(r)

    def _put(self, record: bytes) -> None:
        import zstandard
        if not self.name:
            self.name, self.bytes, self.records = f"{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = self.fs.open_output_stream(f"{self.folder}/_{self.name}", compression=None)
            if self.dictionary:
                words = zstandard.ZstdCompressor(level=9).compress(self.dictionary)
                self._write(DICT_FRAME.to_bytes(4, "little") + len(words).to_bytes(4, "little") + words)
            info = _record("warcinfo", "urn:uuid:" + str(uuid.uuid4()), [("Content-Type", "application/warc-fields")],
                           b"software: retort\r\nformat: WARC File Format 1.1\r\n", self.date)
            self._write(self.compressor.compress(info))
        self._write(self.compressor.compress(record))
        self.records += 1
        if self.bytes >= self.size:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.held:
            self._begin()
        if self.name:
            self.out.close()
            self.fs.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
            self.done.append((self.name, self.records, self.bytes))
            self.name = ""


def records_of(pages: DataFrame, least: int = LEAST, path: str | None = None) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses) of every page.

    Only digests that occur more than once are written for the join, so that
    it can be split at a payload that a third of all pages share.
    """
    spark = pages.sparkSession
    path = path or stage_path(spark, f"warc-first-{uuid.uuid4().hex}")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("digest", F.unhex(F.sha2("html", 256)))
    firsts = (p.where(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
              .select("digest", "first"))
    firsts.write.parquet(path)
    firsts = spark.read.schema(firsts.schema).parquet(path)
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return (p.join(firsts, "digest", "left")
            .select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"), F.when(again, F.col("first")).alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, size: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write the pages as archives into ``folder`` (new or empty); returns the manifest: name, records, bytes."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    uri = store.makeQualified(at).toString()
    uri = re.sub(r"^file:/+", "file:///", uri)
    scratch = stage_path(spark, f"warc-{uuid.uuid4().hex}")

    def run(batches):
        out = _Archives(uri, size, date)
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, digest, refers_to = (b.column(c)[i].as_py() for c in range(5))
                out.add(page_record(page_id, url, html, digest, refers_to, date))
        out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "records", "bytes"), d)) for d in out.done],
                                         pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    manifest = f"{scratch}/manifest"
    (records_of(pages, least, f"{scratch}/first").mapInArrow(run, "name string, records long, bytes long")
     .write.parquet(manifest))
    manifest = spark.read.schema("name string, records long, bytes long").parquet(manifest)
    _remove_unlisted(spark, folder, uri, manifest)
    drop_path(spark, f"{scratch}/first")
    return manifest


def _remove_unlisted(spark: SparkSession, folder: str, uri: str, manifest: DataFrame) -> None:
    """Remove archives that lost or repeated task attempts left (listed without reading them)."""
    names = _files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))

    def remove(batches):
        from pyarrow import fs
        store, at = fs.FileSystem.from_uri(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                store.delete_file(f"{at}/{name}")
            yield b

    names.join(manifest, "name", "left_anti").select("name").mapInArrow(remove, "name string").count()


# ------------------------------------------------------------------ reading

def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives of a folder, ``READ``'s columns; ``payloads``: with the responses' html."""
    names = [f.name for f in READ]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(READ)
        for b in batches:
            for i in range(b.num_rows):
                archive, rows, weight = b.column(0)[i].as_py(), [], 0
                for place, r in enumerate(records(memoryview(b.column(1)[i].as_buffer()))):
                    payload = r.pop("payload", None)
                    html = None if payload is None or not payloads else payload.decode("utf-8", "replace")
                    rows.append(dict.fromkeys(names) | r | {"archive": archive, "place": place, "html": html})
                    weight += 100 + len(html or "")
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, weight = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, folder).select("path", "content").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives under the shared folder and return what reading them gives, without payloads."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    folder = stage_path(spark, f"archives-{uuid.uuid4().hex}")
    write_archives(pages, folder)
    found = read_archives(spark, folder, payloads=False).where("record_type IS DISTINCT FROM 'warcinfo'").checkpoint()
    drop_path(spark, folder)
    return found
