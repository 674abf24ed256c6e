"""Evaluation metrics as DataFrame aggregations.

Every metric is one aggregation (partial aggregates are combined
map-side), or a per-row array expression followed by one aggregation.
Threshold sweeps and ROC curves never cross-join scores with thresholds:
each row is bucketed once to the first threshold that flips it, the
per-bucket counts are accumulated over the (fixed-size) threshold table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.functions import smiles as sm
from retort.plans.rowindex import running_sum


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ predictions

def beam_pivot(long: DataFrame, id_col: str = "id", rank: str = "rank", seq: str = "seq",
               score: str = "score", k: int = 5) -> DataFrame:
    """(id, rank, seq, score) -> id, '0th'..'{k-1}th', '0th score'.. (explicit pivot values: no extra job)."""
    p = long.groupBy(id_col).pivot(rank, list(range(k))).agg(F.first(seq).alias("s"), F.first(score).alias("c"))
    cols = [F.col(f"{i}_s").alias(f"{i}th") for i in range(k)] + \
           [F.col(f"{i}_c").alias(f"{i}th score") for i in range(k)]
    return p.select(id_col, *cols)


def first_valid_candidate(long: DataFrame, id_col: str = "id", rank: str = "rank", seq: str = "pred",
                          score: str = "score", valid=sm.is_valid_smiles) -> DataFrame:
    """Best-ranked valid candidate and its score per id; null when none is valid."""
    ok = F.coalesce(valid(F.col(seq)), F.lit(False))
    best = F.min_by(F.struct(F.col(seq).alias("s"), F.col(score).alias("c")), F.when(ok, F.col(rank)))
    g = long.groupBy(id_col).agg(best.alias("__b"))
    return g.select(id_col, F.col("__b.s").alias("valid_compound"), F.col("__b.c").alias("valid_score"))


def exact_match_accuracy(df: DataFrame, pred: str, label: str, canon=sm.canonical_fragments) -> DataFrame:
    """Share of rows whose canonical prediction equals the canonical label.

    A failed canonicalisation becomes '' on either side, so two failures match.
    """
    a = F.coalesce(canon(F.col(pred)), F.lit(""))
    b = F.coalesce(canon(F.col(label)), F.lit(""))
    return df.agg(F.avg((a == b).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def topk_hits(wide: DataFrame, target: str, k: int = 5, canon=sm.canonical_fragments,
              ks=(1, 2, 3, 5)) -> DataFrame:
    """Per row: rank of the first canonical match (0 = none) and top-k flags."""
    preds = F.array(*[canon(F.col(f"{i}th")) for i in range(k)])
    t = canon(F.col(target))
    r = F.when(t.isNull(), F.lit(0)).otherwise(F.array_position(preds, t)).cast("int")
    out = wide.withColumn("hit_rank", r)
    for kk in ks:
        out = out.withColumn(f"top{kk}", ((F.col("hit_rank") >= 1) & (F.col("hit_rank") <= kk)).cast("int"))
    return out


def topk_accuracy(wide: DataFrame, target: str, k: int = 5, canon=sm.canonical_fragments,
                  ks=(1, 2, 3, 5)) -> DataFrame:
    h = topk_hits(wide, target, k, canon, ks)
    return h.agg(*[F.avg(f"top{kk}").alias(f"top{kk}_accuracy") for kk in ks], F.count(F.lit(1)).alias("n"))


def invalidity(wide: DataFrame, k: int = 5, valid=sm.is_valid_smiles) -> DataFrame:
    """Per row: how many of the first k outputs are invalid (trailing dots ignored)."""
    outs = F.array(*[F.col(f"{i}th") for i in range(k)])
    bad = F.size(F.filter(outs, lambda x: ~F.coalesce(valid(F.rtrim(x, F.lit("."))), F.lit(False))))
    return wide.withColumn("invalidity", bad)


def invalidity_rate(wide: DataFrame, k: int = 5, valid=sm.is_valid_smiles) -> DataFrame:
    """sum(invalid outputs) / (rows * k) * 100."""
    x = invalidity(wide, k, valid)
    return x.agg((F.sum("invalidity") / (F.count(F.lit(1)) * k) * 100).alias("invalidity_pct"),
                 F.sum("invalidity").alias("invalid_outputs"))


# ------------------------------------------------------------------ regression

def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MSE, RMSE and R2 = 1 - SSE/SST (not regr_r2, which is squared correlation)."""
    e2 = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    g = df.agg(F.sum(e2).alias("sse"), F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("vp"))
    return g.select((F.col("sse") / F.col("n")).alias("mse"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                    (F.lit(1.0) - F.col("sse") / (F.col("vp") * F.col("n"))).alias("r2"), "n")


def within_tolerance_accuracy(df: DataFrame, y: str, p: str, tol: float = 10.0) -> DataFrame:
    return df.agg(F.avg((F.abs(F.col(y) - F.col(p)) <= tol).cast("double")).alias("within_tol"))


# ------------------------------------------------------------------ classification

def _prf(tp, fp, fn):
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return prec, rec, f1


def classification_metrics(df: DataFrame, target: str, pred: str) -> DataFrame:
    """accuracy, precision, recall, F1 for the positive class 1 (0 when a denominator is 0)."""
    t, p = F.col(target).cast("int"), F.col(pred).cast("int")
    g = df.agg(F.sum(((t == 1) & (p == 1)).cast("double")).alias("tp"),
               F.sum(((t == 0) & (p == 1)).cast("double")).alias("fp"),
               F.sum(((t == 1) & (p == 0)).cast("double")).alias("fn"),
               F.sum(((t == 0) & (p == 0)).cast("double")).alias("tn"))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    prec, rec, f1 = _prf(tp, fp, fn)
    return g.select(((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


def confusion_matrix(df: DataFrame, target: str, pred: str, labels=(0, 1)) -> DataFrame:
    """target x pred counts; rows = true label, columns pred_<label>."""
    p = df.groupBy(F.col(target).cast("int").alias(target)).pivot(
        pred, list(labels)).agg(F.count(F.lit(1)))
    return p.select(target, *[F.coalesce(F.col(str(lab)), F.lit(0)).alias(f"pred_{lab}") for lab in labels])


def _first_flip(score: Column, step: float, steps: int) -> Column:
    """Smallest i in [0, steps) with i*step >= score (steps when none): rows with
    score > i*step are predicted positive exactly for thresholds i < result."""
    est = F.greatest(F.least(F.ceil(score / F.lit(step)), F.lit(steps)), F.lit(0)).cast("long")
    est = F.when((est > 0) & ((est - 1) * F.lit(step) >= score), est - 1).otherwise(est)
    return F.when((est < steps) & (est * F.lit(step) < score), est + 1).otherwise(est)


def _flip_table(df: DataFrame, target: str, score: str, step: float, steps: int) -> DataFrame:
    """Per threshold i: counts of class-1 and class-0 rows with score <= i*step (cumulative)."""
    spark = df.sparkSession
    hist = df.groupBy(_first_flip(F.col(score), step, steps).alias("i")).agg(
        F.sum((F.col(target) == 1).cast("long")).alias("c1"),
        F.sum((F.col(target) == 0).cast("long")).alias("c0"))
    grid = spark.range(0, steps).withColumnRenamed("id", "i")
    t = grid.join(hist, "i", "left").fillna(0, subset=["c1", "c0"])
    # fixed-size threshold table (steps rows): a single ordered window is bounded
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tot = hist.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).withColumn("__k", F.lit(1))
    t = t.select("i", F.sum("c1").over(w).alias("le1"), F.sum("c0").over(w).alias("le0")).withColumn("__k", F.lit(1))
    return t.join(F.broadcast(tot), "__k").drop("__k").withColumn("thresh", F.col("i") * F.lit(step))


def threshold_sweep(df: DataFrame, target: str, score: str, step: float = 0.01, steps: int = 100) -> DataFrame:
    """Precision/recall/F1 (class 1 positive) of ``score > i*step`` for i in [0, steps)."""
    t = _flip_table(df, target, score, step, steps)
    tp = (F.col("n1") - F.col("le1")).cast("double")
    fp = (F.col("n0") - F.col("le0")).cast("double")
    fn = F.col("le1").cast("double")
    tn = F.col("le0").cast("double")
    prec, rec, f1 = _prf(tp, fp, fn)
    return t.select("i", "thresh", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                    fn.cast("long").alias("fn"), tn.cast("long").alias("tn"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def roc_curve(df: DataFrame, target: str, score: str, step: float = 0.0001, steps: int = 10001) -> DataFrame:
    """TPR/FPR at thresholds i*step with class 0 as the positive class.

    Predicted class 1 = score > t, so TP = class-0 rows with score <= t.
    """
    t = _flip_table(df, target, score, step, steps)
    tpr = F.col("le0") / F.col("n0")
    fpr = F.col("le1") / F.col("n1")
    return t.select("i", "thresh", tpr.alias("tpr"), fpr.alias("fpr"))


def roc_auc(df: DataFrame, target: str, score: str) -> DataFrame:
    """Area under the ROC of ``score`` for class 1 (ties count one half).

    Per distinct score: (n1, n0); negatives strictly below come from a
    bucketed running sum, so no single task sorts all scores.
    """
    g = df.groupBy(F.col(score).alias("s")).agg(
        F.sum((F.col(target) == 1).cast("long")).alias("n1"),
        F.sum((F.col(target) == 0).cast("long")).alias("n0"))
    r = running_sum(g, ["s"], "n0", out="below0", inclusive=False)
    return r.agg((F.sum(F.col("n1") * (F.col("below0") + F.col("n0") * 0.5))
                  / (F.sum("n1") * F.sum("n0"))).alias("auc"))


# ------------------------------------------------------------------ logits

def argmax_label(v) -> Column:
    """0-based index of the first maximum."""
    x = _c(v)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def softmax(v) -> Column:
    x = _c(v)
    m = F.array_max(x)
    e = F.transform(x, lambda a: F.exp(a - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, a: acc + a)
    return F.transform(e, lambda a: a / s)


def cross_entropy(v, label) -> Column:
    """log-sum-exp(v) - v[label]; null for label -100 (ignored)."""
    x = _c(v)
    m = F.array_max(x)
    lse = F.log(F.aggregate(x, F.lit(0.0), lambda acc, a: acc + F.exp(a - m))) + m
    lab = _c(label)
    return F.when(lab != -100, lse - F.element_at(x, (lab + 1).cast("int")))


def masked_token_accuracy(df: DataFrame, preds: str, labels: str) -> DataFrame:
    """Micro accuracy over positions whose label is not -100 (no explode)."""
    pairs = F.arrays_zip(F.col(preds).alias("p"), F.col(labels).alias("l"))
    kept = F.filter(pairs, lambda s: s["l"] != -100)
    right = F.size(F.filter(kept, lambda s: s["p"] == s["l"]))
    return df.agg((F.sum(right) / F.sum(F.size(kept))).alias("accuracy"), F.sum(F.size(kept)).alias("n_tokens"))


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    """exp(mean loss); overflow gives +inf."""
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"), F.avg(loss).alias("eval_loss"))


# ------------------------------------------------------------------ logs

def weighted_running_mean(df: DataFrame, val: str, n: str, order: list, by: list | None = None,
                          out: str = "running_avg") -> DataFrame:
    """sum(val*n)/sum(n) over all rows so far (AverageMeter).

    Also returns the running numerator/denominator (``cum_weighted``,
    ``cum_n``).  With a DECIMAL ``val`` the running sums are exact, so the
    result does not depend on the order in which partial sums are added.
    """
    x = df.withColumn("__vn", F.col(val) * F.col(n)).withColumn("__n", F.col(n).cast("long"))
    r = running_sum(x, order, ["__vn", "__n"], by=by, out=["cum_weighted", "cum_n"])
    r = r.withColumn("cum_weighted", F.col("cum_weighted").cast("double"))
    return r.withColumn(out, F.col("cum_weighted") / F.col("cum_n").cast("double")).drop("__vn", "__n")


def early_stopping(log: DataFrame, metric: str, by: list, epoch: str = "epoch", patience: int = 2,
                   mode: str = "min", segment: int = 1024) -> DataFrame:
    """Replay an epoch log: best so far, epochs since best, stop at patience.

    Returns per run: best_epoch, best_value (within the epochs actually
    run), stop_epoch (null when patience never ran out), epochs_run.  The
    best so far is a running minimum of (value, epoch), taken inside
    segments of epochs that start from the minimum of those before, so a
    run of any length is spread over tasks; runs are then reduced map-side.
    """
    value = F.col(metric) if mode == "min" else -F.col(metric)
    at = F.when(F.col(metric).isNotNull(), F.struct(value.alias("v"), F.col(epoch).alias("e")))
    x = log.select(*by, F.col(epoch).alias("__e"), F.floor(F.col(epoch) / segment).alias("__seg"), at.alias("__at"))
    prior = Window.partitionBy(*by).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy(*by, "__seg").agg(F.min("__at").alias("m"), F.count(F.lit(1)).alias("c"))
    before = parts.select(*by, "__seg", F.min("m").over(prior).alias("__m"), F.coalesce(F.sum("c").over(prior), F.lit(0)).alias("__c"))
    own = Window.partitionBy(*by, "__seg").orderBy("__e").rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(before, [*by, "__seg"]).select(
        *by, "__e", F.least(F.min("__at").over(own), F.col("__m")).alias("best"),
        (F.count(F.lit(1)).over(own) + F.col("__c")).alias("n"))
    row = F.struct("best", "n", "__e")
    spent = F.col("__e") - F.col("best.e") >= patience
    g = y.groupBy(*by).agg(F.min_by(row, F.when(spent, F.col("__e"))).alias("stop"), F.max_by(row, "__e").alias("last"))
    end = F.coalesce("stop", "last")
    best = end["best"]["v"] if mode == "min" else -end["best"]["v"]
    return g.select(*by, end["best"]["e"].alias("best_epoch"), best.alias("best_value"),
                    F.col("stop.__e").alias("stop_epoch"), end["n"].alias("epochs_run"))


def best_trial(trials: DataFrame, value, by: list | None = None, maximise: bool = True) -> DataFrame:
    """The trial row with the best value.  ``value`` may be a list: later
    names break ties (compared as a struct), so the pick is deterministic."""
    vals = [value] if isinstance(value, str) else list(value)
    by = list(by or [])
    key = F.struct(*[F.col(v) for v in vals])
    packed = F.struct(*[F.col(c) for c in trials.columns if c not in by])
    agg = (F.max_by if maximise else F.min_by)(packed, key)
    g = trials.groupBy(*by).agg(agg.alias("__t"))
    return g.select(*by, *[F.col("__t")[c].alias(c) for c in trials.columns if c not in by])


def first_token_embedding(vectors) -> Column:
    """The first token's vector of a matrix (``array<array<float>>``); null for an empty one."""
    return F.get(F.col(vectors) if isinstance(vectors, str) else vectors, F.lit(0))
