"""Features, forest fits, random search and batched inference with Spark ML.

``hashed_fingerprint`` is *not* a circular (Morgan) fingerprint: it hashes
SMILES token 1..3-grams into a binary vector of width ``dim`` by the first
32 bits of their md5, so that other engines get the same bits.  Same shape
and role in the models (a fixed-width 0/1 vector per compound string),
different bits.

A forest deeper than 30 (Spark ML's limit) is an error.  Random search
draws trials from a seeded md5 table instead of an adaptive sampler.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.hashing import hash_u32, hash_unit, md5_u32
from retort.operators import metrics as mt

MAX_DEPTH = 30
# SMILES tokens for features: bracket atoms, two-letter halogens, single characters.
FEATURE_TOKEN = r"\[[^\[\]]+\]|Br|Cl|."


def ngrams(tokens: Column, n_max: int = 3) -> Column:
    """tokens ++ 2-grams ++ ... ++ n_max-grams (joined with a blank)."""
    def runs(n):  # a default argument in the lambda would be taken for the position
        return F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))

    parts = [tokens] + [F.when(F.size(tokens) >= n, runs(n)).otherwise(F.array().cast("array<string>"))
                        for n in range(2, n_max + 1)]
    return F.concat(*parts)


def hashed_bits(tokens: Column, dim: int) -> Column:
    """``dim`` zeros and ones: one where some token's 32-bit md5 prefix leaves the position as remainder."""
    places = F.array_distinct(F.transform(tokens, lambda t: md5_u32(t) % dim))
    # bound as a lambda variable, so that the places are computed once a row
    return F.element_at(F.transform(F.array(places), lambda own: F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")),
        lambda i: F.array_contains(own, i).cast("double"))), 1)


def hashed_fingerprint(df: DataFrame, col: str, dim: int = 256, out: str = "features", n_max: int = 3) -> DataFrame:
    """Binary ``dim``-wide vector of hashed SMILES token n-grams (see module note); all zeros for an empty or null string."""
    toks = F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(FEATURE_TOKEN), 0)
    return df.withColumn(out, array_to_vector(hashed_bits(ngrams(toks, n_max), dim)))


def _depth(d: int) -> int:
    if d > MAX_DEPTH:
        raise ValueError(f"max_depth {d} is over Spark ML's limit of {MAX_DEPTH}")
    return d


def fit_forest_regressor(train: DataFrame, label: str, features: str = "features", num_trees: int = 150,
                         max_depth: int = 20, seed: int = 42):
    rf = RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees,
                               maxDepth=_depth(max_depth), seed=seed)
    return rf.fit(train)


def fit_forest_classifier(train: DataFrame, label: str, features: str = "features", num_trees: int = 100,
                          max_depth: int = 10, seed: int = 42, weight_col: str | None = None):
    kw = {"weightCol": weight_col} if weight_col else {}
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees,
                                maxDepth=_depth(max_depth), seed=seed, **kw)
    return rf.fit(train)


def score_regression(model, test: DataFrame, label: str, lo: float = 0.0, hi: float = 100.0,
                     tol: float = 10.0) -> DataFrame:
    """Predict, clip to [lo, hi], one row of r2 / rmse / within-tol share."""
    p = model.transform(test).withColumn("prediction", F.greatest(F.least("prediction", F.lit(hi)), F.lit(lo)))
    r = mt.regression_metrics(p, label, "prediction")
    w = mt.within_tolerance_accuracy(p, label, "prediction", tol)
    return r.withColumn("__k", F.lit(1)).join(w.withColumn("__k", F.lit(1)), "__k").drop("__k")


def trial_table(spark, n_trials: int, seed: int = 42, trees=(10, 200), depth=(2, 30), leaf=(1, 8),
                dims=(256,), rates=(1.0, 1.0)) -> DataFrame:
    """Seeded random-search trials, drawn from md5 of (seed, trial, name).

    Whole numbers from inclusive ranges (trees, depth, smallest leaf), a
    fingerprint width from a list, and a share of rows per tree log-uniform
    between two bounds.
    """
    t = spark.range(n_trials).withColumnRenamed("id", "trial")

    def draw(name):
        return hash_u32(seed, "trial", F.lit(name))

    def whole(name, lo, hi):
        return (F.lit(lo) + draw(name) % (hi - lo + 1)).cast("int")

    width = F.element_at(F.array(*[F.lit(d) for d in dims]), (draw("dim") % len(dims) + 1).cast("int"))
    low, high = math.log(rates[0]), math.log(rates[1])
    rate = F.exp(F.lit(low) + draw("rate") / F.lit(4294967296.0) * F.lit(high - low))
    return t.select("trial", whole("trees", *trees).alias("num_trees"), whole("depth", *depth).alias("max_depth"),
                    whole("leaf", *leaf).alias("min_leaf"), width.alias("dim"), rate.alias("rate"))


def param_search(train: DataFrame, valid: DataFrame, label: str, trials: DataFrame, seed: int = 42,
                 features: str = "features", task: str = "regression", featurise=None, parallelism: int = 1) -> DataFrame:
    """Fit one forest per trial (Spark ML ``fitMultiple``) and score it on ``valid``: R2, or F1 for classes.

    ``featurise(df, dim)`` makes the features for a trial's fingerprint width
    (without it both tables already hold them).  Features of one width are
    made and cached once for all its trials.  The trial table is small by
    construction; each fit is a distributed Spark ML job, and ``parallelism``
    of them are submitted at a time (a fit's result does not depend on it).
    """
    metric = _METRIC[task]
    rows = trials.orderBy("trial").collect()
    scores = _trial_scores(train, valid, label, rows, seed, features, task, featurise, parallelism)
    return train.sparkSession.createDataFrame([(*r, scores[r["trial"]]) for r in rows], f"{_TRIAL}, {metric} double")


def halving_search(train: DataFrame, valid: DataFrame, label: str, trials: DataFrame, key_cols: list, seed: int = 42,
                   features: str = "features", task: str = "regression", featurise=None, parallelism: int = 4,
                   eta: int = 3) -> DataFrame:
    """Successive halving: many trials on few rows, the best on all.

    With n trials there are as many rungs as n can be divided by ``eta``.  A
    rung fits its trials on a share of the rows (all in the last rung, 1 in
    ``eta`` in the one before, and so on; rows are taken by the md5 of 'rung' and
    ``key_cols``, apart from the order that made a split by the same seed,
    and a rung holds the rows of the one before it) and the best
    1 in ``eta`` go on; of equal scores the smaller trial is better.  One row
    for each fit: the trial, ``rung`` from 0, ``share`` and the score; the
    search's result is the best row of the last rung.
    """
    metric = _METRIC[task]
    alive = trials.orderBy("trial").collect()
    rungs = 1
    while len(alive) // eta ** rungs >= 1:
        rungs += 1
    out = []
    for rung in range(rungs):
        share = 1.0 / eta ** (rungs - 1 - rung)
        part = train if share == 1 else train.where(hash_unit(seed, F.lit("rung"), *key_cols) < F.lit(share))
        scores = _trial_scores(part, valid, label, alive, seed, features, task, featurise, parallelism)
        out += [(*r, rung, share, scores[r["trial"]]) for r in alive]
        alive = sorted(alive, key=lambda r: (-scores[r["trial"]], r["trial"]))[:max(1, len(alive) // eta)]
    return train.sparkSession.createDataFrame(out, f"{_TRIAL}, rung int, share double, {metric} double")


_METRIC = {"regression": "r2", "classification": "f1"}
_TRIAL = "trial long, num_trees int, max_depth int, min_leaf int, dim int, rate double"


def _trial_scores(train, valid, label, rows, seed, features, task, featurise, parallelism) -> dict:
    """trial -> score; the trials of one fingerprint width share their cached tables and run side by side."""
    forest = RandomForestRegressor if task == "regression" else RandomForestClassifier
    evaluator = RegressionEvaluator if task == "regression" else MulticlassClassificationEvaluator
    ev = evaluator(labelCol=label, predictionCol="prediction", metricName=_METRIC[task])
    rf = forest(featuresCol=features, labelCol=label, seed=seed)
    scores = {}
    for dim in sorted({r["dim"] for r in rows}):
        own = [r for r in rows if r["dim"] == dim]
        a, b = (featurise(train, dim), featurise(valid, dim)) if featurise else (train, valid)
        a, b = a.cache(), b.cache()
        maps = [{rf.numTrees: int(r["num_trees"]), rf.maxDepth: _depth(int(r["max_depth"])),
                 rf.minInstancesPerNode: int(r["min_leaf"]), rf.subsamplingRate: float(r["rate"])} for r in own]
        a.count(), b.count()  # trials that start together would each make the tables
        fits = rf.fitMultiple(a, maps)

        def one(_, fits=fits, b=b, own=own):
            i, model = next(fits)
            return own[i]["trial"], float(ev.evaluate(model.transform(b)))

        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            scores.update(pool.map(inheritable_thread_target(train.sparkSession)(one), range(len(own))))
        a.unpersist()
        b.unpersist()
    return scores


def swap_fit(a: DataFrame, b: DataFrame, label: str, **kw) -> DataFrame:
    """Fit on a / score on b, and fit on b / score on a."""
    m1 = score_regression(fit_forest_regressor(a, label, **kw), b, label).withColumn("direction", F.lit("a->b"))
    m2 = score_regression(fit_forest_regressor(b, label, **kw), a, label).withColumn("direction", F.lit("b->a"))
    return m1.unionByName(m2)


def batch_predict(df: DataFrame, input_col: str, make_predict_fn, return_type, batch_size: int = 64,
                  input_shape=None, out: str = "prediction", dedup: bool = False) -> DataFrame:
    """Run a user model over a column in Arrow batches (``predict_batch_udf``).

    ``make_predict_fn`` is called once per Python worker and returns a
    numpy ``batch -> predictions`` function.  With ``dedup`` the model
    sees every distinct input once and results are joined back.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                            input_tensor_shapes=[input_shape] if input_shape else None)
    if not dedup:
        return df.withColumn(out, udf(F.col(input_col)))
    d = df.select(input_col).distinct()
    d = d.withColumn(out, udf(F.col(input_col)))
    return df.join(d, input_col, "left")
