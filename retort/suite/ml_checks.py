"""Checks for features, forest fits, random search and batched inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retort.functions import reaction as rx
from retort.operators import labels as lb
from retort.operators import metrics as mt
from retort.operators import ml
from retort.plans import corpora
from retort.plans.rowindex import oversample_minority, split_fraction
from retort.session import checkpoint_dir
from retort.sources import io
from retort.sources import testdata as td
from retort.suite import register
from retort.suite.reactions import BASE, SQL_YIELD, clean


def yield_rows(spark, sf):
    y = corpora.yield_corpus(clean(spark, sf))
    return y.select(rx.untag_prompt("input").alias("flat"), (F.col("YIELD") * 100).alias("label"), "input")


def yield_features(spark, sf, dim=200):
    return ml.hashed_fingerprint(yield_rows(spark, sf), "flat", dim=dim)


def kept(df):
    """The rows put down once under the shared folder; their order and partitions stay, on which a forest's draws depend."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


SQL_GRAMS = """
fx_toks AS (SELECT input, YIELD * 100 AS label, regexp_extract_all(regexp_replace(replace(replace(replace(input, 'REACTANT:', ''), 'REAGENT:', '.'), 'PRODUCT:', '.'), '. ', '', 'g'), '\\[[^\\[\\]]+\\]|Br|Cl|.') AS t FROM fx_yield),
fx_places AS (SELECT input, label, list_distinct(list_transform(
    t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
      || list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]),
    lambda g: CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 200)) AS own FROM fx_toks)"""


@register("hashed_fingerprint", td.with_sql(*BASE, SQL_YIELD, SQL_GRAMS) + """
 SELECT input, label, list_transform(range(200), lambda i: CASE WHEN list_contains(own, i) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bits FROM fx_places""")
def _fingerprint(spark, sf):
    f = yield_features(spark, sf, dim=200)
    from pyspark.ml.functions import vector_to_array
    return f.select("input", "label", vector_to_array("features").alias("bits"))


def _train_test(spark, sf):
    f = kept(yield_features(spark, sf))  # a fit reads its rows three times, a score twice
    s = split_fraction(f, ["input", "label"], seed=42, test_size=0.1)
    return s.where("split = 'train'"), s.where("split = 'test'")


def _split_rows(spark, sf):
    """Train and test rows without features, each put down by itself: every table of features begins with one of them."""
    s = split_fraction(yield_rows(spark, sf), ["input", "label"], seed=42, test_size=0.1)
    return kept(s.where("split = 'train'")), kept(s.where("split = 'test'"))


@register("fit_forest_regressor")
def _fit_rf(spark, sf):
    train, test = _train_test(spark, sf)
    model = ml.fit_forest_regressor(train, "label", num_trees=50, max_depth=8)
    return ml.score_regression(model, test, "label")


@register("fit_forest_classifier")
def _fit_rfc(spark, sf):
    lab = lb.binary_labels(clean(spark, sf))
    parts = split_fraction(lab, ["smiles", "target"], seed=42, test_size=0.25)
    train = oversample_minority(parts.where("split = 'train'").drop("split"), "target", 1, k=10, key_cols=["smiles"], seed=42)
    model = ml.fit_forest_classifier(ml.hashed_fingerprint(train, "smiles", dim=256), "target", num_trees=50, max_depth=6)
    pred = model.transform(ml.hashed_fingerprint(parts.where("split = 'test'"), "smiles", dim=256)).withColumn("pred", F.col("prediction").cast("int"))
    return mt.confusion_matrix(pred, "target", "pred")


@register("param_search")
def _param_search(spark, sf):
    train, valid = _split_rows(spark, sf)
    trials = ml.trial_table(spark, 3, seed=42, trees=(10, 40), depth=(2, 10), dims=(128, 256), rates=(0.5, 1.0))
    res = ml.param_search(train, valid, "label", trials, featurise=lambda df, dim: ml.hashed_fingerprint(df, "flat", dim=dim))
    return mt.best_trial(res, ["r2", "trial"], maximise=True)


@register("halving_search")
def _halving_search(spark, sf):
    """Nine trials on a ninth of the rows, three on a third, the best on all; four fits side by side."""
    train, valid = _split_rows(spark, sf)
    trials = ml.trial_table(spark, 9, seed=42, trees=(10, 40), depth=(2, 10), dims=(128, 256), rates=(0.5, 1.0))
    return ml.halving_search(train, valid, "label", trials, ["input", "label"],
                             featurise=lambda df, dim: ml.hashed_fingerprint(df, "flat", dim=dim))


@register("param_search_classes")
def _param_search_classes(spark, sf):
    s = split_fraction(lb.binary_labels(clean(spark, sf)), ["smiles", "target"], seed=42, test_size=0.25)
    trials = ml.trial_table(spark, 2, seed=7, trees=(10, 30), depth=(2, 8), dims=(64, 128))
    res = ml.param_search(s.where("split = 'train'"), s.where("split = 'test'"), "target", trials, task="classification",
                          featurise=lambda df, dim: ml.hashed_fingerprint(df, "smiles", dim=dim))
    return mt.best_trial(res, ["f1", "trial"], maximise=True)


@register("swap_fit")
def _swap_fit(spark, sf):
    train, test = _train_test(spark, sf)
    return ml.swap_fit(train, test, "label", num_trees=20, max_depth=6)


def make_softmax_model():
    """Stand-in model: the vector is already a row of logits."""
    def predict(x: np.ndarray):
        x = x.astype(np.float64)
        z = x - x.max(axis=1, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(axis=1, keepdims=True)
        return {"label": p.argmax(axis=1).astype(np.int32), "prob": np.round(p.max(axis=1), 6).astype(np.float64)}
    return predict


@register("batch_predict", """
 SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label,
        round(1.0 / list_sum(list_transform(embedding, lambda a: exp(CAST(a AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 6) AS prob
 FROM embeddings""")
def _batch_predict(spark, sf):
    e = td.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>"))
    rt = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("prob", T.DoubleType())])
    p = ml.batch_predict(e, "embedding", make_softmax_model, rt, batch_size=64, input_shape=[64])
    return p.select("vec_id", "prediction.label", "prediction.prob")


def make_length_model():
    """Stand-in model over prompts: how many characters, as a score."""
    def predict(x: np.ndarray):
        return np.array([float(len(t)) for t in x.reshape(-1)])
    return predict


@register("inline_row", td.with_sql(*BASE, SQL_YIELD) + """
 SELECT input, CAST(length(input) AS DOUBLE) AS prediction FROM fx_yield ORDER BY length(input) DESC, input LIMIT 1""")
def _inline_row(spark, sf):
    """Prediction of a single prompt: the longest one of the corpus, found by an aggregate, put in as text."""
    prompts = corpora.yield_corpus(clean(spark, sf))
    longest = prompts.agg(F.min_by("input", F.struct(-F.length("input"), F.col("input"))).alias("input")).first()["input"]
    return ml.batch_predict(io.inline_row(spark, longest), "input", make_length_model, T.DoubleType())
