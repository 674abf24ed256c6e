"""Exact positions, splits, sampling and metrics."""

from pyspark.sql import functions as F

from retort.operators import metrics as mt
from retort.plans import rowindex as ri


def test_global_index_is_a_permutation(spark):
    df = spark.range(0, 5000).repartition(7).withColumn("k", F.col("id") * 3)
    x = ri.global_index(df, ["k"], buckets=13)
    rows = x.select("k", "idx", "n").collect()
    assert sorted(r.idx for r in rows) == list(range(5000))
    assert all(r.idx == r.k // 3 for r in rows) and rows[0].n == 5000


def test_global_index_by_group_with_hot_group(spark):
    df = spark.range(0, 3000).withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50))
    x = ri.global_index(df, ["id"], by=["g"], buckets=16)
    per = {}
    for r in x.collect():
        per.setdefault(r.g, []).append(r.idx)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_split_sizes_exact_and_stable(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "row_id")
    a = ri.split_train_valid_test(df, ["row_id"]).groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in a}
    assert sizes == {"test": 100, "valid": 100, "train": 803}
    b = ri.split_train_valid_test(df.repartition(5), ["row_id"]).orderBy("row_id").collect()
    c = ri.split_train_valid_test(df.repartition(2), ["row_id"]).orderBy("row_id").collect()
    assert b == c


def test_oversample_minority(spark):
    df = spark.createDataFrame([(i, 1 if i < 5 else 0) for i in range(50)], "id long, y int")
    out = ri.oversample_minority(df, "y", 1, k=100, key_cols=["id"])
    assert out.where("y = 1").count() == 505 and out.count() == 550


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "id long, y int")
    f = ri.stratified_folds(df, "y", ["id"], k=10)
    counts = {r.fold: r["count"] for r in f.groupBy("fold").count().collect()}
    assert sorted(counts) == list(range(10)) and sum(counts.values()) == 100
    assert max(counts.values()) - min(counts.values()) <= 1


def test_exact_match_two_failures_match(spark):
    df = spark.createDataFrame([("C(", "C1CC"), ("CCO", "CCO"), ("CO", "CCO")], "p string, t string")
    r = mt.exact_match_accuracy(df, "p", "t").collect()[0]
    assert abs(r.accuracy - 2 / 3) < 1e-12


def test_first_valid_candidate(spark):
    df = spark.createDataFrame([(1, 0, "C(", -1.0), (1, 1, "CCO", -2.0), (2, 0, "C(", -1.0)],
                               "id long, rank int, pred string, score double")
    got = {r.id: (r.valid_compound, r.valid_score) for r in mt.first_valid_candidate(df).collect()}
    assert got == {1: ("CCO", -2.0), 2: (None, None)}


def test_early_stopping(spark):
    df = spark.createDataFrame([(1, e, l) for e, l in enumerate([3.0, 2.0, 4.0, 5.0, 1.0], start=1)],
                               "run int, epoch int, loss double")
    r = mt.early_stopping(df, "loss", ["run"], patience=2).collect()[0]
    assert (r.best_epoch, r.stop_epoch, r.best_value, r.epochs_run) == (2, 4, 2.0, 4)


def test_regression_r2_is_not_squared_correlation(spark):
    df = spark.createDataFrame([(float(i), float(i) / 2) for i in range(1, 11)], "y double, p double")
    r = mt.regression_metrics(df, "y", "p").collect()[0]
    sse = sum((i - i / 2) ** 2 for i in range(1, 11))
    mean = 5.5
    sst = sum((i - mean) ** 2 for i in range(1, 11))
    assert abs(r.r2 - (1 - sse / sst)) < 1e-12


def test_roc_auc_matches_pairwise_definition(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.3), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame(data, "target int, score double")
    got = mt.roc_auc(df, "target", "score").collect()[0].auc
    pos = [s for t, s in data if t == 1]
    neg = [s for t, s in data if t == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_threshold_sweep_matches_brute_force(spark):
    import random
    rnd = random.Random(1)
    data = [(rnd.randint(0, 1), round(rnd.random(), 3)) for _ in range(300)]
    df = spark.createDataFrame(data, "target int, score double")
    rows = {r.i: r for r in mt.threshold_sweep(df, "target", "score").collect()}
    for i in (0, 13, 50, 99):
        t = i * 0.01
        tp = sum(1 for y, s in data if y == 1 and s > t)
        fp = sum(1 for y, s in data if y == 0 and s > t)
        assert (rows[i].tp, rows[i].fp) == (tp, fp)


def test_early_stopping_over_segments_and_modes(spark):
    import random
    from retort.operators import metrics as mt
    rng = random.Random(6)
    runs = {r: [rng.randint(0, 50) for _ in range(rng.randint(1, 40))] for r in range(30)}
    df = spark.createDataFrame([(r, e + 1, float(v)) for r, vs in runs.items() for e, v in enumerate(vs)], "run int, epoch int, loss double")
    for mode, sign in (("min", 1), ("max", -1)):
        expected = {}
        for r, vs in runs.items():
            best, at, stop = None, 0, None
            for e, v in enumerate(vs, 1):
                if best is None or sign * v < sign * best:
                    best, at = v, e
                if e - at >= 3:
                    stop = e
                    break
            expected[r] = (at, float(best), stop, stop or len(vs))
        got = mt.early_stopping(df, "loss", ["run"], "epoch", patience=3, mode=mode, segment=4)
        assert {x.run: (x.best_epoch, x.best_value, x.stop_epoch, x.epochs_run) for x in got.collect()} == expected


def test_cut_offs_equal_a_sort_for_any_key(spark, monkeypatch):
    import datetime
    import random

    from pyspark.sql import functions as F

    from retort.plans import rowindex as ri
    monkeypatch.setattr(ri, "FEW", 5)
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(-3, 4)]), rng.choice([None, "", "a", "ab", "b", "é", "http://long/prefix/" + "x" * rng.randint(0, 3)]),
             rng.choice([None, datetime.date(2020, 1, rng.randint(1, 28))]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, s string, d date, i long").repartition(7)
    place = lambda r: tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in r)
    for n in (0, 1, 7, 133, 399, 400, 999):
        for order in (["a", "s", "d", "i"], ["s", "i"], ["d", "i"]):
            key = lambda r: place([r["asdi".index(c)] for c in order])
            got = ri.head_slice(df, order, n=n)
            assert sorted(r.i for r in got.collect()) == sorted(r[3] for r in sorted(rows, key=key)[:n])
            assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Window", "Sort", "hashpartitioning", "rangepartitioning"))
    for n in (3, 200, 399):
        got = ri.sample_n(df, ["i"], n, seed=5)
        assert got.count() == n
        kept = sorted(r.i for r in df.withColumn("h", F.md5(F.concat_ws("|", F.lit("5"), "i"))).orderBy("h").limit(n).collect())
        assert sorted(r.i for r in got.collect()) == kept
    split = ri.split_train_valid_test(df, ["i"], frac=0.13)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 52, "valid": 52, "train": 296}


def test_cut_offs_of_repeated_keys_empty_tables_and_doubles(spark):
    from pyspark.sql import functions as F

    from retort.plans import rowindex as ri
    same = spark.range(50_000).select(F.when(F.col("id") < 10, F.col("id")).otherwise(7).alias("k"))
    assert ri.head_slice(same, ["k"], n=20_000).count() == 7  # rows that share the cut-off key stay together, behind it
    assert ri.sample_fraction(same.limit(0), ["k"], 0.5).count() == 0
    assert ri.split_fraction(same.limit(0), ["k"]).columns == ["k", "split"]
    d = spark.range(100).select((F.col("id") / 7).alias("x"))
    assert ri.head_slice(d, ["x"], n=30).agg(F.max("x")).first()[0] == 29 / 7
    assert ri.split_head_percent(d, ["x"], 5.0).where("split = 'validation'").count() == 5


def test_exact_quantiles_of_different_equal_and_skewed_values(spark, monkeypatch):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from retort.operators import aggregates as ag
    monkeypatch.setattr(ag, "FEW", 20)
    rng = random.Random(2)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for values in ([rng.gauss(0, 1) * 10 ** rng.randint(-200, 200) for _ in range(5000)], [7.0] * 3000 + [rng.random() for _ in range(500)],
                   list(range(999)), [3], [-1.5, 2.5]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        got = ag.exact_quantiles(df, "v", shares)
        assert np.allclose(got, np.quantile(np.array(values, float), shares), rtol=1e-12, atol=0)
    assert ag.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    plan = ag.length_profile(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    assert ag.length_profile(df.where(F.lit(False)), "v").first().asDict() == dict.fromkeys(("mean", "std", "min", "p25", "p50", "p75", "max")) | {"count": 0}


def test_matrices_round_trip(spark, tmp_path):
    from retort.operators.metrics import first_token_embedding
    from retort.sources import io
    df = spark.createDataFrame([(1, [float(i) for i in range(7)]), (2, []), (3, None)], "k int, v array<float>")
    m = df.select("k", io.as_matrix("v", 3).alias("m"))
    io.sink_arrays(m, str(tmp_path / "m"))
    back = {r.k: (r.m, r.f) for r in io.read_arrays(spark, str(tmp_path / "m"), m.schema).withColumn("f", first_token_embedding("m")).collect()}
    assert back == {1: ([[0.0, 1.0, 2.0], [3.0, 4.0, 5.0], [6.0]], [0.0, 1.0, 2.0]), 2: ([], None), 3: ([], None)}


def test_fingerprint_bits(spark):
    """Positions of all 1..3-grams by hand; empty and null strings are all zeros."""
    import hashlib
    from pyspark.ml.functions import vector_to_array
    from retort.operators import ml
    df = spark.createDataFrame([(1, "C[Na+]BrO"), (2, "C"), (3, ""), (4, None)], "n int, x string")
    got = {r.n: {i for i, v in enumerate(r.b) if v} for r in
           ml.hashed_fingerprint(df, "x", 64).select("n", vector_to_array("features").alias("b")).collect()}
    t = ["C", "[Na+]", "Br", "O"]
    grams = [" ".join(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    place = lambda g: int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 64
    assert got == {1: set(map(place, grams)), 2: {place("C")}, 3: set(), 4: set()}


def test_span_lengths_of_a_table(spark):
    from retort.operators import tokens as tk
    df = spark.createDataFrame([(1, 512), (2, 114), (3, None), (4, 512)], "n int, len int")
    got = {r.n: (r.raw_length, r.target_length) for r in tk.span_lengths_of(df, "len").collect()}
    assert got == {1: tk.span_lengths(512), 2: tk.span_lengths(114), 3: (None, None), 4: tk.span_lengths(512)}


def test_search_side_by_side_equals_serial(spark):
    """Same scores whatever the parallelism; halving keeps the best of each rung and ends on all rows."""
    from pyspark.ml.functions import array_to_vector
    from retort.operators import ml
    rows = spark.range(400).select("id", *[(F.col("id") * k % m / m).alias(f"x{k}") for k, m in ((7, 31), (11, 17))])
    rows = rows.select("id", (F.col("x7") * 3 - F.col("x11")).alias("label"), array_to_vector(F.array("x7", "x11")).alias("features"))
    rows = rows.repartition(2, "id").cache()
    train, valid = rows.where("id % 5 > 0"), rows.where("id % 5 = 0")
    trials = ml.trial_table(spark, 4, seed=3, trees=(2, 5), depth=(1, 5), rates=(0.6, 1.0))
    serial = {r.trial: r.r2 for r in ml.param_search(train, valid, "label", trials).collect()}
    assert {r.trial: r.r2 for r in ml.param_search(train, valid, "label", trials, parallelism=4).collect()} == serial
    steps = ml.halving_search(train, valid, "label", trials, ["id"], eta=2).collect()
    by = [{r.trial: r.r2 for r in steps if r.rung == k} for k in range(3)]
    assert [len(x) for x in by] == [4, 2, 1] and [min(r.share for r in steps if r.rung == k) for k in range(3)] == [0.25, 0.5, 1.0]
    for now, after in zip(by, by[1:]):
        assert set(after) == set(sorted(now, key=lambda t: (-now[t], t))[:len(after)])
    last = next(iter(by[2]))
    assert by[2][last] == serial[last]
