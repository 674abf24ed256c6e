"""Every operator against a plain version of its definition, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r))


# ------------------------------------------------------------ 1 quality rules

def base_figures(t):
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed)


def test_quality_base_figures(spark, odd, labels):
    from retort.llm import qualify
    out = qualify.score(odd, qualify.fit(odd, labels)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((i, *base_figures(t)) for i, t in texts_of(odd))
    assert all(not r.kept for r in out if r.base_failed)
    assert all(r.llr is None for r in out if not r.n_words)


def test_quality_score_follows_the_multinomials(spark):
    from retort.llm import qualify
    good = [(i, f"alpha beta gamma delta good{i % 7} " * 20) for i in range(40)]
    bad = [(100 + i, f"junk### spam### buy### now### bad{i % 7} " * 20) for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    weights = qualify.fit(docs, labels)
    llr = {r.doc_id: r.llr for r in qualify.score(docs, weights).collect()}
    assert min(llr[i] for i, _ in good) > qualify.THRESHOLD > max(llr[i] for i, _ in bad)
    twice = docs.withColumn("text", F.repeat("text", 3))  # length does not change a score by much
    for r in qualify.score(twice, weights).collect():
        assert abs(r.llr - llr[r.doc_id]) < 0.02


def test_quality_counts_every_trusted_document(spark):
    from retort.llm import qualify
    docs = spark.range(150_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 64).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert not qualify.fit(docs, labels.union(labels)).any()  # the target is the whole corpus, whatever its size
    half = qualify.fit(docs, labels.where("doc_id % 64 < 32"))
    raw, most = 150_000 / 64, 150_000 / 2
    assert abs(half.max() / qualify.UNIT - math.log((raw + 20) / (raw * most / 150_000 + 20))) < 1e-2


def test_quality_odd_tables(spark, odd, none, labels):
    from retort.llm import qualify
    assert qualify.score(none, qualify.fit(none, labels)).count() == 0
    w = qualify.fit(odd, labels.where("false"))
    assert not w.any()
    kept = qualify.keep(odd, w)
    assert kept.columns == odd.columns and kept.count() == qualify.score(odd, w).where("kept").count()


# ------------------------------------------------------------ 2 suffix-array dedup

def remove_repeats(docs, n=50):
    least = {}
    big = float("inf")
    raw = [(big if i is None else i, t.encode()) for i, t in docs]
    for i, t in raw:
        for k in range(len(t) - n + 1):
            s = t[k:k + n]
            least[s] = min(i, least.get(s, big))
    out = Counter()
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if least[t[k:k + n]] < i:
                gone[k:k + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone)))
        out[(None if i == big else i, len(t), runs, kept)] += 1
    return out


def dedup_rows(df):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("hot, bucket_anchors", [(10_000, 200), (2, 200), (10_000, 0.01), (2, 0.01)])
def test_repeats_match_brute_force(spark, hot, bucket_anchors):
    from retort.llm import substrings
    import random
    rng = random.Random(5)
    vocabulary = ["ab", "cd", "e", "fgh", "é", "zz "]
    pieces = ["".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pieces)[rng.randint(0, 9):] for _ in range(rng.randint(0, 4)))) for i in range(120)]
    docs += [(500 + i, "a" * (45 + 7 * i)) for i in range(4)] + [(600 + i, "xyz" * 40) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes = dict(block_bytes=3000, bucket_anchors=bucket_anchors, hot=hot)
    layout = substrings.Layout(sum(len(t.encode()) for _, t in docs), **sizes)
    assert layout.blocks > 3 and layout.bits > (0 if bucket_anchors > 1 else 16)  # more than 65,536 buckets
    assert dedup_rows(substrings.dedup(df, **sizes)) == remove_repeats(docs)


def test_repeats_odd_tables(spark, odd, none):
    from retort.llm import substrings
    small = odd.where("doc_id is null or doc_id not in (8, 10, 13)")
    assert dedup_rows(substrings.dedup(small)) == remove_repeats(texts_of(small))
    assert substrings.dedup(none).count() == 0
    long = substrings.dedup(odd.where("doc_id in (8, 10, 13)")).collect()
    by = {r.doc_id: r for r in long}
    assert bytes(by[10].kept) and bytes(by[8].kept) == b"x" * 200_000
    assert len(by[13].kept) < 60  # all but what the added tail reaches


def test_interval_tree_reports_maximal_repeats():
    import numpy as np
    from retort.llm.substrings import LENGTH, Repeats
    core = bytes(range(65, 65 + 26)) * 2 + b"0123456789"  # 62 bytes
    texts = [b"pq" + core + b"rs", b"pq" + core + b"tu", b"vw" + core[:55] + b"zzzz"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    r = Repeats(buf, end - [len(t) for t in texts], end)
    found = set()
    for n, lo, hi in zip(r.length, r.lo, r.hi):
        found.add((int(n), frozenset((int(r.owner[k]), int(r.at[k])) for k in range(lo, hi + 1))))
    assert (64, frozenset({(0, 0), (1, 0)})) in found  # shared by two, with what stands before it
    assert (55, frozenset({(0, 2), (1, 2), (2, 2)})) in found  # shared by all three
    assert all(n >= LENGTH for n, _ in found)
    assert len(found) == 2


# ------------------------------------------------------------ 3 resharding

def test_min_cost_flow_moves_the_fewest_bytes():
    from retort.llm import reshard
    supply, demand = [50, 10, 30], [30, 30, 20, 10]
    flow = reshard.min_cost_flow(supply, demand, lambda i, j: 0 if i == j else 1)
    assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(3)] == supply
    assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(4)] == demand
    assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - sum(map(min, supply, demand))
    costs = [[4, 1, 9], [2, 6, 3]]  # a case in which the greedy choice is not the best
    flow = reshard.min_cost_flow([3, 3], [2, 2, 2], lambda i, j: costs[i][j])
    assert sum(costs[i][j] * v for (i, j), v in flow.items()) == 14
    with pytest.raises(ValueError):
        reshard.min_cost_flow([1], [2], lambda i, j: 0)


def test_reshard(spark, odd, none, tmp_path):
    from retort.llm import reshard
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), F.pmod(F.xxhash64("id"), F.lit(300)).cast("int")).alias("text"))
    old = F.when(F.col("doc_id") < 1200, 0).otherwise(F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    out = reshard.reshard(docs, old).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    text = {r.doc_id: r.text for r in docs.collect()}
    sizes, slots = Counter(), {}
    for r in out:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) < 700
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.size for r in out if r.moved)
    least = sum(sizes.values()) - sum(min(s, sum(sizes.values()) // 16) for s in
                                      Counter_sum((r.old_shard, r.size) for r in out).values())
    assert abs(moved - least) < 3000
    rows = reshard.reshard(odd, F.lit(3)).collect()
    assert len(rows) == odd.count() and all(r.size == 1 for r in rows if r.doc_id in (1, 2))
    assert reshard.reshard(none, F.lit(0)).count() == 0
    flow, n = reshard.plan(reshard.sized(docs, old))
    placed = reshard.place(reshard.sized(docs, old), flow, n)
    changed = reshard.affected(flow)
    reshard.rewrite(docs, placed, changed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == placed.where(F.col("shard").isin(changed)).count()


def Counter_sum(pairs):
    out = Counter()
    for k, v in pairs:
        out[k] += v
    return out


# ------------------------------------------------------------ 4 Jaccard join

def shingles(t, n=5):
    w = WORD.findall(t)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups_by_force(rows):
    ids = {}
    for i, t in rows:
        ids.setdefault(t, []).append(i)
    keys = list(ids)
    sets = [shingles(t) for t in keys]
    parent, links = list(range(len(keys))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    members = {}
    for k in range(len(keys)):
        members.setdefault(find(k), []).extend(i for i in ids[keys[k]] if i is not None)
    return Counter((i, min(members[find(k)], default=None), len(ids[t]), links[k]) for k, t in enumerate(keys) for i in ids[t])


def test_join_matches_brute_force(spark, monkeypatch):
    from retort.llm import setjoin
    import random
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(300):
        w = list(base[rng.randint(0, 11)] if i % 3 else base[0])
        for _ in range(rng.randint(0, 4)):
            w[rng.randint(0, 59)] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, "a b c"), (1001, "a b c"), (1002, ""), (1003, ""), (1004, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in setjoin.linked(df).collect())
    assert out == groups_by_force(rows)
    monkeypatch.setattr(setjoin, "BUCKET", 20)  # deeper splits and tiles
    monkeypatch.setattr(setjoin, "TILE", 16)
    out = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in setjoin.linked(df).collect())
    assert out == groups_by_force(rows)
    kept = {r.doc_id for r in setjoin.one_of_each(df).collect()}
    expected = {c for _, c, _, _ in groups_by_force(rows)}
    assert kept == expected


def test_join_odd_tables(spark, odd, none):
    from retort.llm import setjoin
    out = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in setjoin.linked(odd).collect())
    assert out == groups_by_force(texts_of(odd))
    kept = setjoin.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 8, 9, 10, 11, 12])
    assert setjoin.linked(none).count() == 0 and setjoin.one_of_each(none).count() == 0


def test_components_of_a_long_chain(spark):
    from retort.llm import setjoin
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in setjoin.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# ------------------------------------------------------------ 5 HTML

def test_html_layout():
    from retort.llm.htmltext import parse, render
    text = lambda h: render(parse(h))
    assert text("<p>one<p>two<br>three") == "one\n\ntwo\nthree"
    assert text("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>") == "- a\n- b\n  3. x\n  4. y\n- c"
    assert text("<table><tr><th>Name<th>Qty<tr><td>apples<td>12</table>") == "Name   | Qty\napples | 12"
    assert text("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td colspan=2>wide</table>") == "r | 1\n  | 2\nwide"
    assert text("a<script>var t='</p>';</script><style>p{}</style><!-- c -->b") == "ab"
    assert text("<title>t</title><div hidden>x</div><div style='display: none'>y</div><p>z &amp; w&nbsp;v") == "z & w v"
    assert text("<p style=visibility:hidden>a <b style=visibility:visible>b</b></p>") == "b"
    assert text("<pre> a\n   b</pre>") == " a\n   b"
    assert text("<details><summary>s</summary>x</details><details open>y</details>") == "s\ny"
    assert text("<table>stray<tr><td>in</table>") == "stray\n\nin"
    assert text("1 < 2 <b>bold</i> text</b>") == "1 < 2 bold text"
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("") == "" and text("<!-- open") == "" and text("<p") == "<p"


def test_html_odd_tables(spark):
    from retort.llm import htmltext
    rows = [(1, None, "u"), (None, "<p>x", None), (2, "", "u"), (2, "", "u")]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert Counter((r.page_id, r.text) for r in out.collect()) == Counter([(1, ""), (None, "x"), (2, ""), (2, "")])
    assert htmltext.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


PAGE_PARTS = ["<p>", "</p>", "<b", '<a href="x">', "<a title='", '"', ">", "<", "<!--", "-->", "<![CDATA[", "]]>", "<!x>", "<?y", "text ", " ", "\n",
              "<ul>", "<li>", "</ul>", "<ol start=3>", "<table>", "<tr>", "<td>", "<td colspan=2>", "</table>", "<caption>", "<div>", "</div>",
              "<h1>", "<script>", "</script>", "<textarea>", "</textarea>", "<title>", "<select>", "<option>", "</select>", "<br>", "<button>",
              "</button>", "/", "&amp;", "<li value=7>", "<dl><dt>", "<dd>", "<pre>", "</pre>", "<body hidden>", "|"]


def test_page_tokens_equal_a_plain_pattern():
    """Random broken pages: the same tokens as one backtracking pattern gives, and no page fails."""
    import random
    from retort.llm import htmltext
    plain = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng = random.Random(9)
    for _ in range(4000):
        page = "".join(rng.choice(PAGE_PARTS) for _ in range(rng.randint(1, 25)))
        tokens, at, got = htmltext._Tokens(page), 0, []
        while (x := tokens.after(at)) is not None:
            got.append(x)
            at = x[1]
        want = []
        for m in plain.finditer(page):
            if m[3]:
                want.append((m.start(), m.end(), m[2] or "<", m[3].lower(), m[4]))
            else:
                want.append((m.start(), m.end(), "!", "", "") if m[1] is None else (m.start(), m.end(), "[", m[1], ""))
        assert got == want, page
        htmltext.render(htmltext.parse(page))


def test_page_of_hostile_shape_takes_linear_time():
    import time
    from retort.llm import htmltext
    size = 1_000_000
    for part in ("<a ", "<a", '<a "', '<a "\'', "<!", "<![CDATA[>", "<ul>" + "<li>x" * 50, "<ol><li>x</li>", "<div>", "<textarea></textarea>", "<"):
        t = time.process_time()
        htmltext.render(htmltext.parse(part * (size // len(part))))
        assert time.process_time() - t < 8, part
    items = "<ol>" + "<li>x" * 100_000 + "</ol>"
    assert htmltext.render(htmltext.parse(items)).endswith("\n100000. x")


def test_page_shows_formulas_drawings_list_boxes_and_bars():
    from retort.llm.htmltext import parse, render
    show = lambda h: render(parse(h))
    assert show("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b") == "a x=2 b"
    assert show("<p>one<svg><title>no</title><g><text>axis <tspan>label</tspan></text></g><desc>no</desc><path d='1'/></svg>") == "one axis label"
    options = "<option>red<option selected>green<option>blue"
    assert show(f"<select>{options}</select>") == "green"
    assert show(f"<select multiple>{options}</select>").split() == show(f"<select size=3>{options}</select>").split() == ["red", "green", "blue"]
    assert show("<table><tr><td>a</td><td>b |</td></tr><tr><td>c</td><td></td></tr></table>") == "a | b |\nc"
    assert show("<table><td><![CDATA[x</table>") is not None and show("<table></button></table><table><b><td>x") is not None


# ------------------------------------------------------------ 6 decontamination

def coverage_by_force(item, text, least):
    """Greedy string tiling by definition: always mark the longest unmarked common run."""
    a, b = [False] * len(item), [False] * len(text)
    total = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and not a[i + k] and not b[t + k]:
                    k += 1
                best = max(best, (k, -i, -t))
        if best[0] < least:
            return total
        k, i, t = best[0], -best[1], -best[2]
        a[i:i + k], b[t:t + k] = [True] * k, [True] * k
        total += k


def test_tiling_matches_brute_force():
    import random
    import numpy as np
    from retort.llm.decontaminate import tile
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.randint(1, 9) for _ in range(rng.randint(4, 40))]
        text = []
        for _ in range(4):
            a = rng.randint(0, len(item) - 1)
            text += item[a:a + rng.randint(1, 20)] + [rng.randint(1, 9)]
        out = tile(np.array(item, np.uint64), np.array(text, np.uint64))
        used_i, used_t = Counter(), Counter()
        for n, i, t in out:
            assert n >= 4 and item[i:i + n] == text[t:t + n]
            used_i.update(range(i, i + n))
            used_t.update(range(t, t + n))
        assert max(used_i.values(), default=1) == 1 and max(used_t.values(), default=1) == 1
        assert out[0][0] if coverage_by_force(item, text, 4) else not out
        if out:  # the longest run is always a tile, and lengths fall
            assert out[0][0] == max(n for n, _, _ in out)
        assert abs(sum(n for n, _, _ in out) - coverage_by_force(item, text, 4)) <= 4  # ties may be marked in another order


def greedy_by_force(item, text, least):
    """The longest common run of unmarked words, marked again and again; ties to the first in the item, then in the text."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while (i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n]
                       and i + n not in used_i and t + n not in used_t):
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return out
        out.append(best)
        used_i.update(range(i, i + n))
        used_t.update(range(t, t + n))


def test_tiling_equals_greedy_by_force():
    import random
    import numpy as np
    from retort.llm.decontaminate import tile
    rng = random.Random(5)
    for k in range(150):
        item = [rng.randint(1, rng.choice((1, 2, 3, 30))) for _ in range(rng.randint(0, 45))]
        text = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, max(0, len(item) - 1))
            text += item[a:a + rng.randint(1, 25)] + [rng.randint(1, 3)]
        assert tile(np.array(item, np.uint64), np.array(text, np.uint64)) == greedy_by_force(item, text, 4), k


def test_tiling_of_equal_words_takes_linear_room():
    import time
    import numpy as np
    from retort.llm.decontaminate import tile
    for period in (1, 2, 7):
        item, text = (np.arange(n, dtype=np.uint64) % np.uint64(period) for n in (200, 20_000))
        t = time.process_time()
        assert tile(item, text) == [(200, 0, 0)]
        assert tile(text[:2000], item)[0] == (200, 0, 0)
        assert time.process_time() - t < 1


def test_decontamination_of_items_with_repeated_passages(spark):
    from retort.llm import decontaminate
    item = "row row row your boat " * 8
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "row row row your boat then nothing")], "doc_id long, text string")
    assert {r.doc_id: (r.leaked, r.coverage) for r in decontaminate.verdicts(docs, bench).collect()} == {1: (True, 1.0), 2: (False, None)}


def test_decontamination(spark, odd, none):
    from retort.llm import decontaminate
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil fresh turnips in winter"
    w = item.split()
    bench = spark.createDataFrame([(0, item), (1, None), (2, "too short"), (3, item), (None, "x y z u v w"), (7, "")],
                                  "item_id long, text string")
    filler = " and so on in other words "
    rows = [(0, filler + item + filler), (1, filler.join([" ".join(w[12:]), " ".join(w[6:12]), " ".join(w[:6])])),
            (2, filler.join(w)), (3, " ".join(w[:8])), (4, item.upper().replace(" ", "!! ")), (5, None), (6, filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.leaked, r.item_id) for r in decontaminate.verdicts(docs, bench).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, None), 3: (False, None), 4: (True, 0), 5: (False, None), 6: (False, None)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 3, 5, 6}
    assert decontaminate.verdicts(odd, bench).count() == odd.count()
    assert decontaminate.clean(odd, bench.where("false")).columns == odd.columns
    assert decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.verdicts(none, bench).count() == 0


# ------------------------------------------------------------ 7 secrets

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
         lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(t):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t) if ok(m)]
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_base_spans(spark, odd):
    from retort.llm import queries, secrets
    rows = [(100, "token: token: abcdefgh"), (101, "é PASSWORD='aaaaaa' api_key=\"zzzzzzz.z\" " + "ab12" * 9),
            (102, "AKIA" + "B" * 15 + " AKIA" + "C" * 16), (103, "Key secreſ=abcdefg"), (104, "0" * 23 + "g" + "0" * 24)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    out = Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in secrets.KINDS[:3]))
                  for r in secrets.scan(docs).collect())
    assert out == Counter((i, base_spans(t)) for i, t in texts_of(docs))
    assert hashlib.sha256(b"assign:0:15").hexdigest() == secrets.span_digest([(0, 0, 15)])


def test_secret_structures():
    import base64
    import json
    from retort.llm import secrets
    der = lambda tag, body: bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else
                                            b"\x82" + len(body).to_bytes(2, "big")) + body
    rsa = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 40) for k in range(8)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + b"\x05\x00") + der(4, rsa))
    ec = der(0x30, der(2, b"\1") + der(4, b"\7" * 32))
    for key in (rsa, pkcs8, ec):
        assert secrets.der_private_key(key)
        assert not secrets.der_private_key(key[:-1]) and not secrets.der_private_key(key + b"\0")
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"pub") + field(b"private" * 5)
    assert secrets.openssh_private_key(ssh) and not secrets.openssh_private_key(ssh[:-1])
    b64 = base64.b64encode(rsa).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[i:i + 64] for i in range(0, len(b64), 64)) + "\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find(t)]
    assert kinds(f"x {pem} y") == ["key"] and kinds(f"x {b64} y") == ["key"]
    assert "key" in kinds("k " + rsa.hex() + " z") and kinds("x " + base64.b64encode(b"no key at all here, only prose in base64").decode()) == []
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    signed = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    assert kinds(f"see {signed} now") == ["signed"]
    assert kinds(f"see {part({'typ': 'x', 'a': 1})}.{part({'sub': '1'})}.c2ln now") == []


def test_secret_keys_wrapped_and_escaped():
    import base64
    from retort.llm import secrets
    der = lambda tag, body: bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else
                                            b"\x82" + len(body).to_bytes(2, "big")) + body
    rsa = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 40) for k in range(8)))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"pub") + field(b"private" * 15)
    keys = lambda t: [t[s:e] for s, k, e in secrets.find(t) if k == 3]
    for key in (rsa, ssh):
        for text in (base64.b64encode(key).decode(), key.hex(), key.hex().upper()):
            lines = [text[i:i + 64] for i in range(0, len(text), 64)]
            for sep in ("\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    ", "\\\n"):
                assert keys(f"key: {sep.join(lines)} end") == [sep.join(lines)]
                assert keys(f'"{sep}{sep.join(lines)}{sep}"') == [sep.join(lines)]
                assert keys(sep.join(["plainwordsofmorethantwentyletters", *lines, "after", *lines, "x"])) == [sep.join(lines)] * 2
                assert not keys("key: " + sep.join(lines[:-1])) and not keys("key: " + sep.join(lines[1:]))
    b64 = base64.b64encode(rsa).decode()
    lines = ["-----BEGIN RSA PRIVATE KEY-----", *(b64[i:i + 64] for i in range(0, len(b64), 64)), "-----END RSA PRIVATE KEY-----"]
    for sep in ("\n", "\\n", "\\r\\n", "\\\\n", "\\n\" +\n  \"", "'\n '", "\", \""):
        assert keys(f'{{"private": "{sep.join(lines)}{sep}"}}') == [sep.join(lines)]
        assert not keys(sep.join([*lines[:2], *lines[3:]]))


def test_secret_tokens_behind_dotted_names_and_armour_without_ends():
    """Names before a token hide nothing; a stray BEGIN line hides no later key; marks without an end cost linear time."""
    import base64
    import json
    import time
    from retort.llm import secrets
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    signed = lambda t: [t[a:b] for a, k, b in secrets.find(t) if k == 4]
    for before in ("", "longidentifier12.", "https://example-host-name.", "a.b.longidentifier12.other-long-name.", "x" * 40 + ".y."):
        assert signed(f"see {before}{token} now") == [token]
    assert signed(f"{token}.{token}") == [token, token]
    assert signed("plain.dotted-name-here.with.many-parts-of-words") == []

    numbers = b"".join(b"\x02\x10" + bytes(range(1, 17)) for _ in range(8))
    body = b"\x02\x01\x00" + numbers
    b64 = base64.b64encode(b"\x30\x81" + bytes([len(body)]) + body).decode()
    begin, end = "-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END RSA PRIVATE KEY-----"
    lines = "\n".join(b64[i:i + 64] for i in range(0, len(b64), 64))
    stray = begin + "no key here\n"
    text = stray + "-----END EC PRIVATE KEY-----\n" + stray + begin + lines + end
    assert (text.rindex(begin), 3, len(text)) in secrets.find(text)
    for hostile in (begin * 32_000, "-----BEGIN A PRIVATE KEY-----\n-----END B PRIVATE KEY-----\n" * 16_000, "a." * 500_000,
                    "A" * 1_000_000, "abcdefghijklmnop." * 60_000, begin + "\\" * 1_000_000 + end):
        t = time.process_time()
        secrets.find(hostile)
        assert time.process_time() - t < 4


def test_secret_removal(spark, odd, none):
    from retort.llm import secrets
    out = {r.doc_id: r.text for r in secrets.without_secrets(odd).collect()}
    assert out[9] == "[secret] and [secret]" and out[1] is None and out[2] == ""
    assert secrets.without_secrets(odd).columns == odd.columns
    assert secrets.without_secrets(none).count() == 0 and secrets.scan(none).count() == 0


# ------------------------------------------------------------ 8 packing

def test_packing_round_trip(spark, odd, none):
    import numpy as np
    import public_tokenizers as files
    from tokenizers import Tokenizer
    from retort.llm import packing
    full = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    more = [(200, "it's  a\n\n test 　 x <|endoftext|> y"), (201, " lead"), (202, "a" * 3000 + " " * 70 + "\t b")]
    docs = odd.select("doc_id", "text").where("doc_id is null or doc_id <> 8").unionByName(
        spark.createDataFrame(more, "doc_id long, text string"))
    rows = packing.pack(packing.tokenise(docs), 2).collect()
    expected = Counter((i, tuple(full.encode(t, add_special_tokens=False).ids + [2])) for i, t in texts_of(docs))
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 1024
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, tuple(ids.tolist())))
    for (i, ids), copies in expected.items():
        assert len(ids) <= 1024 or sorted(p for p, _, _ in pieces[i]) == list(range(-(-len(ids) // 1024)))
        for _, start, part in pieces[i]:
            assert any(part == want[start:start + len(part)] for (j, want) in expected if j == i)
        assert sum(len(p) for _, _, p in pieces[i]) == sum(len(w) * c for (j, w), c in expected.items() if j == i)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 1024
    assert packing.pack_documents(none).count() == 0


def test_best_fit_by_definition():
    import random
    from retort.llm.packing import BestFit
    rng = random.Random(2)
    fit, bins, made = BestFit(100, 8), {}, 0
    for _ in range(3000):
        n = rng.randint(1, 100)
        fits = [(free, k) for k, free in bins.items() if free >= n]
        number, offset = fit.place(n)
        if fits:
            assert bins[number] == min(fits)[0] and offset == 100 - bins[number]
        else:
            if len(bins) == 8:
                fullest = min(bins.values())
                gone = [k for k, f in bins.items() if f == fullest]
                assert number == made
                bins.pop(gone[-1])
            assert number == made and offset == 0
            made += 1
            bins[number] = 100
        bins[number] -= n
        if not bins[number]:
            del bins[number]
        if len(bins) < fit.open:
            raise AssertionError
        if sorted(bins.values()) != sorted(f for f, b in enumerate(fit.bins) for _ in b):
            raise AssertionError
        bins = {k: f for f, b in enumerate(fit.bins) for k in b}


# ------------------------------------------------------------ 9 toxicity

def test_toxicity_held_out_accuracy(spark):
    from retort.llm import toxicity
    import random
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(1500):
        w = [f"w{rng.randint(0, 300)}" for _ in range(40)]
        bad = i % 8 == 0
        if bad:
            for _ in range(4):
                w[rng.randint(0, 39)] = rng.choice(["vile", "Nasty,", "AWFUL!!", "rotten"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    truth = dict(marks)
    out = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_toxicity_reads_no_held_out_label(spark):
    from retort.llm import toxicity
    docs = spark.createDataFrame([(i, f"a b c w{i % 9} {'vile' if i % 4 == 0 else 'fine'}") for i in range(300)], "doc_id long, text string")
    honest = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    lying = honest.withColumn("toxic", F.when(~toxicity.learnable(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, honest), toxicity.fit(docs, lying)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_toxicity_odd_tables(spark, odd, none, labels):
    from retort.llm import toxicity
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    empty = toxicity.fit(none, labels.where("false"))
    assert toxicity.score(none, empty).count() == 0
    assert all(r.score == 0 for r in toxicity.score(odd, empty).collect())


# ------------------------------------------------------------ 10 chat logs

def test_chat_snapshots(spark):
    from retort.llm import chatlogs
    q, a = ("user", "q"), ("assistant", "a")
    logs = {1: [q], 2: [q, a], 3: [q, a, q], 4: [q, a, q], 5: [q, ("assistant", "b")], 6: [("user", None)], 7: [("user", "")],
            8: [(None, "q"), a, q, a, ("user", "more")], 9: [("user", "z")]}
    rows = [(c, t + 5 * (c == 2), r, x) for c, v in logs.items() for t, (r, x) in enumerate(v)]
    rows += [(None, 0, "user", "n"), (None, None, "user", "m"), (20, 0, "user", "tie"), (20, 0, "user", "tie"), (21, 0, "user", "tie")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("length", F.lit("x"))
    out = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chatlogs.collapse(chats).collect()}
    assert set(out) == {5, 6, 8, 9, 20, None}
    assert out[6][1] == 2 and out[20][0] == 2 and out[None][0] == 2
    assert out[5][2] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert chatlogs.collapse(chats.where("false")).count() == 0


def test_chat_long_conversation_spans_segments(spark, monkeypatch):
    from retort.llm import chatlogs
    monkeypatch.setattr(chatlogs, "SEGMENT", 7)
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 40), (2, 100), (3, 39)) for t in range(n)] + [(4, t, "user", f"t{t}" if t else "other") for t in range(30)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns) for r in chatlogs.maximal(chats).collect()} == {(2, 100), (4, 30)}
