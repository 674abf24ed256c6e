"""Vector codes, line resampling and WARC archives against plain versions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

# ------------------------------------------------------------ 11 vector codes


def codes_by_force(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    kept = [r for r in kept if len(r[1]) == width]
    cuts = np.append(0, np.cumsum([width // parts + (p < width % parts) for p in range(parts)])).tolist()
    cut = lambda v: [v[a:b] for a, b in zip(cuts, cuts[1:])]
    seeds = [cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[s[p] for s in seeds] for p in range(parts)]

    def near(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for _, v, _ in kept:
                got[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else e for e, g in zip(books[p], got)]
    out = []
    for i, v, label in kept:
        d = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in d), sum(x for x, _ in d), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    return Counter((i, c, e, sums[label]) for i, c, e, label in out), books


def vectors(spark, rows):
    data = [(i, v, label, "k", 1) for i, v, label in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, code string, part int")


def grid(n, width, seed, step=0.25):
    r = np.random.default_rng(seed)
    return [(i, (np.round(r.normal(size=width) / step) * step).tolist(), int(r.integers(3))) for i in range(n)]


@pytest.mark.parametrize("rows", [grid(300, 16, 1), grid(70, 21, 2), grid(40, 5, 3), grid(7, 8, 4), grid(200, 16, 5, 2.0)])
def test_codes_match_brute_force(spark, rows):
    from retort.llm import vectorcodes as V
    codes, books = V.compress(vectors(spark, rows).repartition(3))
    want, want_books = codes_by_force(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()) == want
    assert [b.tolist() for b in books] == want_books
    assert V.digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_codes_of_odd_rows(spark):
    from retort.llm import vectorcodes as V
    good = [(i, [float(i % 5)] * 8, None if i % 4 == 0 else i % 2) for i in range(30)]
    odd = [(50, None, 1), (51, [float("nan")] * 8, 1), (52, [None] + [1.0] * 7, 1), (53, [float("-inf")] * 8, 1), (54, [], 1),
           (55, [1.0] * 3, 1), (None, [2.5] * 8, None), (3, good[3][1], 1), (3, [9.0] * 8, 0)]
    codes, _ = V.compress(vectors(spark, good + odd))
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()) == codes_by_force(good + odd)[0]
    for rows in ([], [(1, None, 1)], [(1, [], None)]):
        codes, books = V.compress(vectors(spark, rows))
        assert codes.columns == ["vec_id", "label", "code", "error", "label_error"] and codes.count() == (rows == [(1, [], None)])
    with pytest.raises(ValueError):
        V.compress(vectors(spark, [(1, [1e30] * 8, 0)]))


def test_walk_of_two_trees_equals_plain_assignment():
    from retort.llm import vectorcodes as V
    r = np.random.default_rng(7)
    for n, w, k, spread in [(5000, 8, 16, 100), (4096, 2, 16, 3), (1000, 1, 5, 50), (33, 4, 1, 9), (900, 3, 256, 40)]:
        centre = r.integers(-5, 6, (20, w)) * 1000
        points = centre[r.integers(20, size=n)] + r.integers(-spread, spread + 1, (n, w))
        book = points[r.integers(n, size=k)].copy()  # equal entries too
        order, depth = V.tree_order(points)
        assert sorted(order) == list(range(n))
        p = points[order]
        owner, total, count, compared = V.nearest(p, *V.node_tables(p, depth), depth, V.EntryTree(book))
        d = ((p[:, None] - book[None]) ** 2).sum(2)
        assert (owner == d.argmin(1)).all()
        assert (count == np.bincount(owner, minlength=k)).all()
        assert (total == np.array([p[owner == e].sum(0) for e in range(k)])).all()
        if n >= 4096 and w == 8:
            assert compared < n / 2  # most points go with their node


# ------------------------------------------------------------ 12 resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def resampled_by_force(docs, target, max_n, buckets, percent, least):
    def grams(t):
        w = WORDS.findall((t or "").translate(LOWER))
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(b for _, x in docs for b in grams(x)[0]), Counter(b for x in target for b in grams(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        g, n = grams(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return Counter(rows), [r[0] for r in order[:percent * len(order) // 100]]


@pytest.mark.parametrize("max_n,buckets", [(1, 10_000), (3, 500)])
def test_resampling_matches_brute_force(spark, odd, max_n, buckets):
    from retort.llm import resample
    lines = ["The quick brown Fox 42", "ÄÖ É中 straße", "", "licence line that all share", "a-b_c d", "one"]
    more = [(100 + i, "\n".join(lines[(i * k) % 6] for k in range(1, 3 + i % 9))) for i in range(60)]
    docs = odd.select("doc_id", "text", "key", "row").union(spark.createDataFrame([(*r, "k", None) for r in more], "doc_id long, text string, key string, row string"))
    target = ["the quick brown fox\nand one more", "licence d", None, "straße é中 ñ"]
    got = resample.resample(docs.repartition(4), spark.createDataFrame([(x, 1) for x in target], "text string, row int"),
                            max_n=max_n, buckets=buckets, percent=40, least_words=4).collect()
    rows, drawn = resampled_by_force([(r.doc_id, r.text) for r in docs.collect()], target, max_n, buckets, 40, 4)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == rows
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [r.doc_id for r in ranked] == drawn


def test_equal_lines_are_counted_once_and_multiplied(spark):
    from retort.llm import resample
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("Same line here\nno "), F.col("id") % 4).alias("text"))
    target = spark.createDataFrame([("NO 1\nno 1\nother",), (None,)], "text string")
    lines = {r.line: (r.n, r.t) for r in resample.distinct_lines(docs.repartition(6), target).collect()}
    assert lines == {"same line here": (400, 0), "other": (0, 1), **{f"no {i}": (100, 2 * (i == 1)) for i in range(4)}}


def test_resampling_of_empty_tables(spark, none, odd):
    from retort.llm import resample
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(none, target).count() == 0
    assert resample.resample(odd, target.limit(0)).count() == odd.count()


# ------------------------------------------------------------ 13 WARC

def pages_by_force(rows, least=100):
    out, first = [], {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html] = min(i, first.get(html, i))
    for i, _, html in rows:
        x = (html or "").encode()
        f = first.get(html) if len(x) >= least else None
        again = f is not None and (i is None or i > f)
        out.append((i, len(x), hashlib.sha256(x).hexdigest(), "revisit" if again else "response", f if again else None))
    return Counter(out)


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é中 payload</p>" * 30
    rows = [(i, f"http://h/{i}", long if i % 3 == 0 else f"<b>{i}</b>" * (i % 40)) for i in range(200)]
    rows += [(500, None, None), (501, "http://a/\r\nX: y \x00ü", ""), (502, "u", "x" * 99), (503, "u", "x" * 99), (504, "u", "x" * 100),
             (505, "u", "x" * 100), (7, "u", long), (0, "u", long), (None, "u", long), (None, "u", "z" * 300), (None, "u", "z" * 300),
             (506, "u", "\r\n\r\nHTTP/1.1 200\r\nContent-Length: 3\r\n\r\n" * 5), (507, "u", "y" * 3_000_000), (-4, "u", "neg" * 50)]
    data = [(*r, "n", 1) for r in rows]
    return rows, spark.createDataFrame(data, "page_id long, url string, html string, name string, records int")


def test_archives_round_trip(spark, pages):
    from retort.llm import warc
    rows, df = pages
    got = warc.round_trip(df.repartition(5))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == pages_by_force(rows)
    assert got.where("problem IS NOT NULL").count() == 0
    empty = warc.round_trip(df.limit(0))
    assert empty.count() == 0 and "payload_digest" in empty.columns


def test_archives_hold_their_payloads_and_a_dictionary(spark, pages, tmp_path):
    from retort.llm import warc
    rows, df = pages
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "left-by-a-lost-attempt.warc.zst").write_bytes(b"half an archive")
    manifest = warc.write_archives(df.repartition(2), str(tmp_path / "a"), size=3_000).collect()
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir() if p.name.endswith(".zst")}
    assert {m.name: m.bytes for m in manifest} == {n: len(b) for n, b in files.items()} and len(files) > 2
    assert sum(m.records for m in manifest) == len(rows)
    assert any(b[:4] == bytes.fromhex("5d2a4d18") for b in files.values())
    got = warc.read_archives(spark, str(tmp_path / "a")).where("record_type = 'response'")
    full = pages_by_force(rows)
    stored = Counter((r.page_id, hashlib.sha256(r.html.encode()).hexdigest()) for r in got.collect())
    assert stored == Counter((k[0], k[2]) for k in full.elements() if k[3] == "response")
    url = next(r.url for r in got.collect() if r.page_id == 501)
    assert url == "http://a/%0D%0AX:%20y%20%00ü"


def test_reader_names_what_is_wrong():
    from retort.llm import warc
    body = b"hello world"
    good = warc.page_record(1, "u", body, hashlib.sha256(body).hexdigest(), None)
    revisit = warc.page_record(2, "u", body, hashlib.sha256(body).hexdigest(), 1)
    words = zstandard.train_dictionary(1024, [good + str(i).encode() * 9 for i in range(200)])
    raw = words.as_bytes()
    plain, known = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(dict_data=words, write_checksum=True)
    frame = lambda magic, x: magic.to_bytes(4, "little") + len(x).to_bytes(4, "little") + x
    for held in (raw, plain.compress(raw)):  # the dictionary as it is, or compressed
        a = frame(warc.DICT_FRAME, held) + known.compress(good) + frame(0x184D2A50, b"note") + known.compress(revisit)
        r = list(warc.records(memoryview(a)))
        assert [x["record_type"] for x in r] == ["response", "revisit"]
        assert r[0]["payload"] == body and r[1]["refers_to"] == 1 and r[1]["payload_bytes"] == len(body)
    streamed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    unsized = streamed.compress(good) + streamed.flush()
    assert next(warc.records(unsized))["payload"] == body
    problems = {
        "version": good.replace(b"WARC/1.1", b"WARX/1.1"), "no warc-date": good.replace(b"WARC-Date", b"WARC-Dote"),
        "Content-Length 1": re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 1\r\n\r\nHTTP", good),
        "no valid": re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: x\r\n\r\nHTTP", good),
        "block digest": good.replace(b"hello", b"jello"), "line ends": good[:-4] + b"....", "malformed": good.replace(b"WARC-Date", b"no header\r\nWARC-Date"),
    }
    for what, record in problems.items():
        r = list(warc.records(plain.compress(record) + plain.compress(good)))
        assert what in r[0]["problem"] and r[1]["payload"] == body, (what, r)
    cut = plain.compress(good) * 2
    assert [("problem" in x) for x in warc.records(cut[:-5])] == [False, True]
    assert list(warc.records(b"not an archive"))[0]["problem"] == "no Zstandard frame"
    assert "cannot be decoded" in list(warc.records(known.compress(good)))[0]["problem"]  # its dictionary is missing
