"""BPE against a brute-force replay on a small fixture; Unigram properties."""

import math
import random
from collections import Counter

from retort.operators import vocab_train as vt

TEXTS = ["C C O", "c 1 c c c c c 1", "C C ( = O ) O", "C C O", "Ċ é"]


def _brute_force_bpe(texts, rounds):
    import regex
    bs = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    cs, n = bs[:], 0
    for b in range(256):
        if b not in bs:
            bs.append(b)
            cs.append(256 + n)
            n += 1
    bm = dict(zip(bs, map(chr, cs)))
    words = Counter()
    for t in texts:
        for m in regex.findall(vt.BYTE_LEVEL_SPLIT, t):
            words[tuple(bm[b] for b in m.encode())] += 1
    res = []
    for r in range(rounds):
        pc = Counter()
        for wd, c in words.items():
            for a, b in zip(wd, wd[1:]):
                pc[(a, b)] += c
        if not pc:
            break
        (a, b), c = sorted(pc.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        res.append((r, a, b, c))
        nw = Counter()
        for wd, c in words.items():
            out, i = [], 0
            while i < len(wd):
                if i + 1 < len(wd) and wd[i] == a and wd[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(wd[i])
                    i += 1
            nw[tuple(out)] += c
        words = nw
    return res


def test_bpe_matches_brute_force(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    merges, _ = vt.train_bpe(vt.byte_level_words(df, "text"), 5, checkpoint_every=2, min_count=1)
    got = [(r["rank"], r["left"], r["right"], r["count"]) for r in merges.orderBy("rank").collect()]
    assert got == _brute_force_bpe(TEXTS, 5)


def test_bpe_in_joint_rounds_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aabcé") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(12)]
    texts += ["aaaa aaaaa abab ababa", *TEXTS]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sizes, step = [], vt._next_merges
    monkeypatch.setattr(vt, "_next_merges", lambda *a: (x := step(*a), sizes.append(len(x)))[0])
    merges, _ = vt.train_bpe(vt.byte_level_words(df, "text"), 120, checkpoint_every=7)
    got = [(r["rank"], r["left"], r["right"], r["count"]) for r in merges.orderBy("rank").collect()]
    assert len(got) == 120 and got == _brute_force_bpe(texts, 120) and max(sizes) > 1


def test_bpe_queries_train_to_the_target_vocabulary(spark, tmp_path):
    from retort.suite import tokens as st
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["reaction", "product", "solvent", "yield"]) for _ in range(9))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert st.BPE_MERGES == 741
    assert {"Ġreaction", "Ġproduct", "Ġsolvent", "Ġyield"} <= {r.left + r.right for r in st._train_bpe(spark, str(tmp_path)).collect()}
    assert {(r.doc_id, r.text) for r in st._encode_bpe(spark, str(tmp_path)).collect()} == set(rows)


def test_unigram_vocab_shape(spark):
    df = spark.createDataFrame([("CCO", 5), ("CCN", 3), ("OCCO", 2)], "word string, n long")
    v = vt.train_unigram(df, vocab_size=10, min_freq=1).orderBy("id").collect()
    assert [r.token for r in v[:3]] == ["<pad>", "</s>", "<unk>"]
    assert {"C", "O", "N"} <= {r.token for r in v}
    assert len(v) <= 10 and [r.id for r in v] == list(range(len(v)))


def _plain_unigram(counts, size, min_freq, shrink, max_len=16):
    """The same training with plain dicts, one EM round before each pruning."""
    subs = lambda w: [w[i:j] for i in range(len(w)) for j in range(i + 1, min(len(w), i + max_len) + 1)]
    freq = Counter()
    for w, n in counts.items():
        for p in subs(w):
            freq[p] += n
    freq = {p: n for p, n in freq.items() if len(p) == 1 or n >= min_freq}
    scores = {p: math.log(n / sum(freq.values())) for p, n in freq.items()}

    def paths(w):
        if not w:
            yield ()
        for j in range(1, min(len(w), max_len) + 1):
            if w[:j] in scores:
                yield from ((w[:j], *rest) for rest in paths(w[j:]))
    while True:
        expected = Counter({p: 0.0 for p in scores if len(p) == 1})
        for w, n in counts.items():
            weight = {p: math.exp(sum(scores[x] for x in p)) for p in paths(w)}
            for path, x in weight.items():
                for p in path:
                    expected[p] += n * x / sum(weight.values())
        total = sum(expected.values())
        scores = {p: math.log(x / total) for p, x in expected.items() if x > 0}
        multi = [p for p in scores if len(p) > 1]
        singles = len(scores) - len(multi)
        if len(scores) <= size or not multi:
            return scores
        loss = {p: expected[p] * (scores[p] - max(sum(scores[x] for x in path) for path in paths(p) if path != (p,))) for p in multi}
        stay = sorted(multi, key=lambda p: (-loss[p], p))[:max(size, int(len(scores) * shrink)) - singles]
        scores = {p: x for p, x in scores.items() if len(p) == 1 or p in stay}
        if len(scores) <= max(size, singles):
            return scores


def test_unigram_equals_plain_training_and_the_driver_gets_no_piece_table(spark, monkeypatch):
    rng = random.Random(5)
    counts = Counter("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    fetched, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (x := collect(self), fetched.append(len(x)))[0])
    vocab = vt.train_unigram(df, vocab_size=43, min_freq=3, sub_rounds=1, shrink=0.6)
    assert max(fetched, default=0) <= 40
    got = {r.token: r.score for r in vocab.collect() if r.id >= 3}
    want = _plain_unigram(counts, 40, 3, 0.6)
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)


def test_encode_unigram_keeps_rare_characters_and_long_pieces(spark, tmp_path):
    from retort.suite import tokens as st
    rows = [(i, "the word reaction is common " * 3 + chr(0x4E00 + i)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vocab = {r.token for r in st.unigram_vocab(st.pieces_df(spark, str(tmp_path))).collect()}
    assert {chr(0x4E00 + i) for i in range(60)} <= vocab and max(map(len, vocab)) > 5
    assert {(r.doc_id, r.text) for r in st._encode_unigram(spark, str(tmp_path)).collect()} == set(rows)


def test_unigram_candidates_over_many_blocks_equal_plain_counts_and_leave_out_rare_parts(spark, monkeypatch):
    rng = random.Random(6)
    counts = Counter("".join(rng.choice("abcé\0" + chr(0x1F600)) for _ in range(rng.randint(1, 20))) for _ in range(400))
    counts["abcabcabcabcabcabcabc"] = 30
    df = spark.createDataFrame([*counts.items(), (None, 7), ("", 3)], "word string, n long")
    monkeypatch.setattr(vt._spread, "__defaults__", (300,))
    want = Counter()
    for w, n in counts.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 16) + 1):
                want[w[i:j]] += n
    listed, counted = [], vt._substrings
    monkeypatch.setattr(vt, "_substrings", lambda lengths, base=0: (listed.append((list(lengths), base)), counted(lengths, base))[1])
    got = {r.piece: r.freq for r in vt.seed_pieces(df, 16, 9).collect()}
    assert got == {p: n for p, n in want.items() if len(p) == 1 or n >= 9}
    assert listed == [([1, 2, 3, 4], 0), *[([m + 1, m + 2], m) for m in range(4, 16, 2)]]
    import pyarrow as pa
    words = pa.table({"block": [0, 0], "word": ["abcdef", "bcdefg"], "n": [2, 5]})
    rows = counted([5, 6], 4)(words, pa.table({"piece": ["abcd", "bcde", "cdef"]})).to_pylist()
    assert {(r["piece"], r["n"]) for r in rows} == {("abcde", 2), ("bcdef", 7), ("abcdef", 2)}


def test_unigram_over_many_blocks_equals_plain_training(spark, monkeypatch):
    rng = random.Random(7)
    counts = Counter("".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(200))
    monkeypatch.setattr(vt._spread, "__defaults__", (150,))
    monkeypatch.setattr(vt, "SLICE_CHARS", 40)
    monkeypatch.setattr(vt, "_ranges", lambda rows: 3)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.token: r.score for r in vt.train_unigram(df, 33, min_freq=2, sub_rounds=1, shrink=0.5).collect() if r.id >= 3}
    want = _plain_unigram(counts, 30, 2, 0.5)
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)


def test_bpe_blocks_hold_whole_words_as_numbers(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(vt, "BLOCK_SYMBOLS", 12)
    words = ["abab", "x", "aaaaa", "é\0é", "", None, "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([3, 9, 2, 1, 5, 5, 4])], names=["word", "n"])
    for wide in (False, True):
        blocks = [*vt._packed(wide)([batch])]
        assert len(blocks) == 2
        a, b, e = ord("a") + 1, ord("b") + 1, [x + 1 for x in "é".encode()]
        pairs = lambda done, fresh: {(r["left"], r["right"]): r["k"] for x in vt._pair_changes(done, fresh, wide)(blocks) for r in x.to_pylist()}
        assert pairs([], []) == {(a, b): 10, (b, a): 3, (a, a): 8, tuple(e): 2, (e[1], 1): 1, (1, e[0]): 1}
        assert pairs([], [(a, b, 300)]) == {(a, b): -10, (b, a): -3, (300, 300): 3}
        assert pairs([(a, b, 300)], [(a, a, 301)]) == {(a, a): -8, (301, 301): 2, (301, a): 2}
        kept = [vt._numbers(s.as_buffer(), wide).tolist() for x in vt._apply([(a, b, 300)], wide)(blocks) for s in x.column(0)]
        assert kept == [[300, 300, 0, *[a] * 5, 0, *e, 1, *e, 0], []]  # "ab" is one symbol now


def test_bpe_over_many_blocks_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("aabc\0é") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(10)]
    monkeypatch.setattr(vt, "BLOCK_SYMBOLS", 60)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    merges, alphabet = vt.train_bpe(vt.byte_level_words(df, "text"), 60, checkpoint_every=3)
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == _brute_force_bpe(texts, 60)
    assert {r.token for r in alphabet.collect()} == {vt.CHAR_OF[b] for b in "".join(texts).encode()}
