"""Checks for metrics, prediction post-processing and log replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.functions import reaction as rx
from retort.operators import aggregates as ag
from retort.operators import metrics as mt
from retort.sources import testdata as td
from retort.suite import register
from retort.suite import sqlbits as q
from retort.suite.reactions import FWD, clean
from retort.plans import corpora

W = td.with_sql
D = "CAST({} AS DOUBLE)".format


def beams_clean(spark, sf):
    b = td.beams_fx(spark, sf)
    return b.select("id", "rank", rx.clean_generated("seq").alias("pred"), "score", "target")


SQL_BC = td.SQL_BEAMS + """,
fx_bc AS (SELECT id, rank, rtrim(replace(seq, ' ', ''), '.') AS pred, score, target FROM fx_beams)"""

SQL_WIDE = SQL_BC + ",\nfx_wide AS (SELECT id, any_value(target) AS target, " + ", ".join(
    f"max(CASE WHEN rank = {i} THEN pred END) AS \"{i}th\"" for i in range(5)) + ", " + ", ".join(
    f"max(CASE WHEN rank = {i} THEN score END) AS \"{i}th score\"" for i in range(5)) + " FROM fx_bc GROUP BY id)"


def wide(spark, sf):
    bc = beams_clean(spark, sf)
    piv = mt.beam_pivot(bc, "id", "rank", "pred", "score", k=5)
    tgt = bc.where("rank = 0").select("id", "target")
    return piv.join(tgt, "id")


@register("beam_pivot", W(SQL_WIDE) + " SELECT * EXCLUDE (target) FROM fx_wide")
def _beam_pivot(spark, sf):
    bc = beams_clean(spark, sf)
    return mt.beam_pivot(bc, "id", "rank", "pred", "score", k=5)


@register("first_valid_candidate", W(SQL_BC) + f"""
 SELECT id, arg_min(pred, CASE WHEN coalesce({q.is_valid('pred')}, false) THEN rank END) AS valid_compound,
        arg_min(score, CASE WHEN coalesce({q.is_valid('pred')}, false) THEN rank END) AS valid_score
 FROM fx_bc GROUP BY id""")
def _first_valid(spark, sf):
    return mt.first_valid_candidate(beams_clean(spark, sf), "id", "rank", "pred", "score")


@register("exact_match_accuracy", W(SQL_BC) + f"""
 SELECT avg(CASE WHEN coalesce({q.canonical('pred')}, '') = coalesce({q.canonical('target')}, '') THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
        count(*) AS n FROM fx_bc WHERE rank = 0""")
def _exact_match(spark, sf):
    return mt.exact_match_accuracy(beams_clean(spark, sf).where("rank = 0"), "pred", "target")


def _sql_hit_rank():
    preds = "[" + ", ".join(q.canonical(f'"{i}th"') for i in range(5)) + "]"
    t = q.canonical("target")
    return f"CASE WHEN {t} IS NULL THEN 0 ELSE coalesce(list_position({preds}, {t}), 0) END"


@register("topk_accuracy", W(SQL_WIDE) + f"""
 , h AS (SELECT {_sql_hit_rank()} AS r FROM fx_wide)
 SELECT avg(CASE WHEN r BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top1_accuracy,
        avg(CASE WHEN r BETWEEN 1 AND 2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top2_accuracy,
        avg(CASE WHEN r BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top3_accuracy,
        avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top5_accuracy, count(*) AS n FROM h""")
def _topk(spark, sf):
    return mt.topk_accuracy(wide(spark, sf), "target", k=5)


def _sql_inval():
    return " + ".join(f"CASE WHEN coalesce({q.is_valid(chr(34) + str(i) + 'th' + chr(34))}, false) THEN 0 ELSE 1 END"
                      for i in range(5))


@register("invalidity_rate", W(SQL_WIDE) + f"""
 , v AS (SELECT {_sql_inval()} AS bad FROM fx_wide)
 SELECT CAST(sum(bad) AS DOUBLE) / (count(*) * 5) * 100 AS invalidity_pct, sum(bad) AS invalid_outputs FROM v""")
def _invalidity(spark, sf):
    return mt.invalidity_rate(wide(spark, sf), k=5)


# ------------------------------------------------------------------ regression / classification

@register("regression_metrics", W(td.SQL_REGRESSION) + """
 SELECT sse / n AS mse, sqrt(sse / n) AS rmse, 1 - sse / (vp * n) AS r2, n
 FROM (SELECT sum((y - p) * (y - p)) AS sse, count(*) AS n, var_pop(y) AS vp FROM fx_regression)""")
def _regression(spark, sf):
    return mt.regression_metrics(td.regression_fx(spark, sf), "y", "p")


@register("within_tolerance_accuracy", W(td.SQL_REGRESSION) + """
 SELECT avg(CASE WHEN abs(y - p) <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE AS within_tol FROM fx_regression""")
def _within(spark, sf):
    return mt.within_tolerance_accuracy(td.regression_fx(spark, sf), "y", "p", 10.0)


@register("classification_metrics", W(td.SQL_SCORES) + """
 , c AS (SELECT sum(CASE WHEN target = 1 AND score > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tp,
                sum(CASE WHEN target = 0 AND score > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fp,
                sum(CASE WHEN target = 1 AND score <= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fn,
                sum(CASE WHEN target = 0 AND score <= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tn FROM fx_scores)
 SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c""")
def _classification(spark, sf):
    s = td.scores_fx(spark, sf)
    from retort.operators.filters import threshold_label
    return mt.classification_metrics(threshold_label(s, "score", 0.5), "target", "pred")


@register("threshold_label", W(td.SQL_SCORES) + " SELECT id, score > 0.97 AS pred FROM fx_scores")
def _threshold_label(spark, sf):
    from retort.operators.filters import threshold_label
    return threshold_label(td.scores_fx(spark, sf), "score", 0.97).select("id", "pred")


@register("confusion_matrix", W(td.SQL_SCORES) + """
 SELECT target, count(*) FILTER (WHERE NOT score > 0.5) AS pred_0, count(*) FILTER (WHERE score > 0.5) AS pred_1
 FROM fx_scores GROUP BY target""")
def _confusion(spark, sf):
    s = td.scores_fx(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return mt.confusion_matrix(s, "target", "pred")


@register("threshold_sweep", W(td.SQL_SCORES) + """
 , c AS (SELECT t.i, t.i * CAST(0.01 AS DOUBLE) AS thresh,
          sum(CASE WHEN s.target = 1 AND s.score > t.i * CAST(0.01 AS DOUBLE) THEN 1 ELSE 0 END)::BIGINT AS tp,
          sum(CASE WHEN s.target = 0 AND s.score > t.i * CAST(0.01 AS DOUBLE) THEN 1 ELSE 0 END)::BIGINT AS fp,
          sum(CASE WHEN s.target = 1 AND NOT s.score > t.i * CAST(0.01 AS DOUBLE) THEN 1 ELSE 0 END)::BIGINT AS fn,
          sum(CASE WHEN s.target = 0 AND NOT s.score > t.i * CAST(0.01 AS DOUBLE) THEN 1 ELSE 0 END)::BIGINT AS tn
        FROM fx_scores s, (SELECT range AS i FROM range(100)) t GROUP BY t.i)
 SELECT i, thresh, tp, fp, fn, tn,
        CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END::DOUBLE AS f1 FROM c""")
def _threshold_sweep(spark, sf):
    return mt.threshold_sweep(td.scores_fx(spark, sf), "target", "score", 0.01, 100)


@register("roc_curve", W(td.SQL_SCORES) + """
 , n AS (SELECT sum(CASE WHEN target = 0 THEN 1 ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END)::DOUBLE AS n1 FROM fx_scores)
 , c AS (SELECT t.i, t.i * CAST(0.0001 AS DOUBLE) AS thresh,
          sum(CASE WHEN s.target = 0 AND NOT s.score > t.i * CAST(0.0001 AS DOUBLE) THEN 1 ELSE 0 END) AS le0,
          sum(CASE WHEN s.target = 1 AND NOT s.score > t.i * CAST(0.0001 AS DOUBLE) THEN 1 ELSE 0 END) AS le1
        FROM fx_scores s, (SELECT range AS i FROM range(10001)) t GROUP BY t.i)
 SELECT i, thresh, le0 / n0 AS tpr, le1 / n1 AS fpr FROM c, n""")
def _roc_curve(spark, sf):
    return mt.roc_curve(td.scores_fx(spark, sf), "target", "score")


@register("roc_auc", W(td.SQL_SCORES) + """
 , g AS (SELECT score AS s, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END)::DOUBLE AS n1,
                sum(CASE WHEN target = 0 THEN 1 ELSE 0 END)::DOUBLE AS n0 FROM fx_scores GROUP BY score)
 , r AS (SELECT *, coalesce(sum(n0) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below0 FROM g)
 SELECT sum(n1 * (below0 + n0 * 0.5)) / (sum(n1) * sum(n0)) AS auc FROM r""")
def _roc_auc(spark, sf):
    return mt.roc_auc(td.scores_fx(spark, sf), "target", "score")


# ------------------------------------------------------------------ logits (embeddings as 8x8 / 64-way)

@register("argmax_label", " SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings")
def _argmax(spark, sf):
    e = td.table(spark, sf, "embeddings")
    return e.select("vec_id", mt.argmax_label("embedding").alias("pred"))


_SQL_LSE = "(ln(list_sum(list_transform(embedding, lambda a: exp(a - list_max(embedding))))) + list_max(embedding))"


@register("softmax_scores", f"""
 SELECT vec_id, round(exp(embedding[label + 1] - list_max(embedding)) /
        list_sum(list_transform(embedding, lambda a: exp(a - list_max(embedding)))), 6) AS p_label FROM embeddings""")
def _softmax(spark, sf):
    e = td.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.element_at(mt.softmax("embedding"), (F.col("label") + 1)), 6).alias("p_label"))


@register("cross_entropy", f" SELECT round(avg({_SQL_LSE} - embedding[label + 1]), 6) AS loss FROM embeddings")
def _cross_entropy(spark, sf):
    e = td.table(spark, sf, "embeddings")
    return e.agg(F.round(F.avg(mt.cross_entropy("embedding", "label")), 6).alias("loss"))


@register("perplexity", f" SELECT round(exp(avg({_SQL_LSE} - embedding[label + 1])), 6) AS perplexity FROM embeddings")
def _perplexity(spark, sf):
    e = td.table(spark, sf, "embeddings").select(mt.cross_entropy("embedding", "label").alias("loss"))
    return mt.perplexity(e, "loss").select(F.round("perplexity", 6).alias("perplexity"))


_SQL_TOK = """
 fx_tok AS (SELECT vec_id,
   list_transform(range(8), lambda j: list_position(list_slice(embedding, j * 8 + 1, j * 8 + 8),
        list_max(list_slice(embedding, j * 8 + 1, j * 8 + 8))) - 1) AS preds,
   list_transform(range(8), lambda j: CASE WHEN (vec_id + j) % 5 = 0 THEN -100 ELSE (vec_id + j) % 8 END) AS labels
 FROM embeddings)"""


def token_view(spark, sf):
    e = td.table(spark, sf, "embeddings")
    preds = F.transform(F.sequence(F.lit(0), F.lit(7)),
                        lambda j: mt.argmax_label(F.slice("embedding", j * 8 + 1, F.lit(8))))
    labels = F.transform(F.sequence(F.lit(0), F.lit(7)),
                         lambda j: F.when((F.col("vec_id") + j) % 5 == 0, F.lit(-100))
                         .otherwise(((F.col("vec_id") + j) % 8).cast("int")))
    return e.select("vec_id", preds.alias("preds"), labels.alias("labels"))


@register("masked_token_accuracy", "WITH" + _SQL_TOK + """
 SELECT sum(len(list_filter(list_zip(preds, labels), lambda s: s[2] <> -100 AND s[1] = s[2])))::DOUBLE /
        sum(len(list_filter(labels, lambda l: l <> -100))) AS accuracy,
        sum(len(list_filter(labels, lambda l: l <> -100))) AS n_tokens FROM fx_tok""")
def _masked_acc(spark, sf):
    return mt.masked_token_accuracy(token_view(spark, sf), "preds", "labels")


@register("first_token_embedding", " SELECT vec_id, list_slice(embedding, 1, 8) AS first_token FROM embeddings")
def _first_token(spark, sf):
    """The first vector of each matrix of token vectors."""
    from retort.sources.io import as_matrix
    e = td.table(spark, sf, "embeddings").select("vec_id", as_matrix("embedding", 8).alias("vectors"))
    return e.select("vec_id", mt.first_token_embedding("vectors").alias("first_token"))


# ------------------------------------------------------------------ logs

@register("weighted_running_mean", W(td.SQL_EPOCHS) + """
 SELECT run, epoch, cw AS cum_weighted, cn AS cum_n, cw / CAST(cn AS DOUBLE) AS running_avg FROM (
   SELECT run, epoch, CAST(sum(CAST(loss AS DECIMAL(18, 2)) * n) OVER w AS DOUBLE) AS cw, sum(n) OVER w AS cn
   FROM fx_epochs WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def _wrm(spark, sf):
    # the loss log holds 2-decimal values: summed as DECIMAL they are exact
    e = td.epochs_fx(spark, sf).withColumn("loss", F.col("loss").cast("decimal(18,2)"))
    return mt.weighted_running_mean(e, "loss", "n", ["epoch"], by=["run"]).select(
        "run", "epoch", "cum_weighted", "cum_n", "running_avg")


@register("step_metric_mean", W(td.SQL_EPOCHS) + " SELECT epoch, avg(loss) AS loss FROM fx_epochs GROUP BY epoch")
def _step_mean(spark, sf):
    return ag.step_metric_mean(td.epochs_fx(spark, sf), "epoch", ["loss"])


@register("early_stopping", W(td.SQL_EPOCHS) + """
 , x AS (SELECT run, epoch, loss, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM fx_epochs)
 , y AS (SELECT *, prior IS NULL OR loss < prior AS is_best FROM x)
 , z AS (SELECT *, epoch - max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since FROM y)
 , s AS (SELECT *, min(CASE WHEN since >= 2 THEN epoch END) OVER (PARTITION BY run) AS stop FROM z)
 SELECT run, max(CASE WHEN is_best THEN epoch END) AS best_epoch, min(loss) AS best_value,
        any_value(stop) AS stop_epoch, count(*) AS epochs_run
 FROM s WHERE stop IS NULL OR epoch <= stop GROUP BY run""")
def _early_stopping(spark, sf):
    return mt.early_stopping(td.epochs_fx(spark, sf), "loss", ["run"], "epoch", patience=2, mode="min")


@register("best_trial", W(td.SQL_EPOCHS) + """
 SELECT run, epoch, loss, n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS rk FROM fx_epochs) WHERE rk = 1""")
def _best_trial(spark, sf):
    e = td.epochs_fx(spark, sf)
    return mt.best_trial(e, ["loss", "epoch"], by=["run"], maximise=False)


# ------------------------------------------------------------------ profiles

@register("length_profile", """
 SELECT count(n_chars) AS count, avg(n_chars)::DOUBLE AS mean, stddev_samp(n_chars) AS std, min(n_chars)::DOUBLE AS min,
        quantile_cont(n_chars, 0.25)::DOUBLE AS p25, quantile_cont(n_chars, 0.5)::DOUBLE AS p50,
        quantile_cont(n_chars, 0.75)::DOUBLE AS p75, max(n_chars)::DOUBLE AS max FROM documents""")
def _length_profile(spark, sf):
    return ag.length_profile(td.table(spark, sf, "documents"), "n_chars")


@register("length_histogram", """
 WITH st AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents)
 SELECT bin, round(lo + bin * (hi - lo) / 1000.0, 6) AS lower, count(*) AS n FROM (
   SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) / ((hi - lo) / 1000.0)), 999) END AS INTEGER) AS bin, lo, hi
   FROM documents, st) GROUP BY bin, lo, hi""")
def _length_histogram(spark, sf):
    return ag.length_histogram(td.table(spark, sf, "documents"), "n_chars", bins=1000)


@register("corpus_counts", W(*FWD) + """
 SELECT 'clean' AS stage, count(*) AS n FROM fx_clean
 UNION ALL SELECT 'product_present', count(*) FROM fx_fwd_base
 UNION ALL SELECT 'reactant_present', count(*) FROM fx_fwd_base WHERE REACTANT <> ' '
 UNION ALL SELECT 'first_per_key', count(*) FROM fx_fwd_first
 UNION ALL SELECT 'max_chars', count(*) FROM fx_fwd""")
def _corpus_counts(spark, sf):
    from retort.operators import filters as fl
    c = clean(spark, sf)
    cols = ["CATALYST", "REACTANT", "REAGENT", "SOLVENT"]
    full = fl.fill_blank_roles(c.where("PRODUCT IS NOT NULL AND REACTANT IS NOT NULL AND REACTANT <> ' '"), [*cols, "PRODUCT"])
    first = corpora.first_per_key(full.select("row_id", "PRODUCT", *cols), ["REACTANT", "CATALYST", "REAGENT", "SOLVENT"])
    prompt = corpora.forward_prompt(first)
    return ag.corpus_counts(
        (c, {"clean": None, "product_present": F.col("PRODUCT").isNotNull(),
             "reactant_present": F.col("REACTANT").isNotNull() & (F.col("REACTANT") != " ")}),
        (prompt, {"first_per_key": None, "max_chars": F.length("input") <= 512}))
