"""Toxicity: non-negative positive-unlabelled learning.

A linear model over the distinct words of a text (ASCII and Latin-1
letters in lower case, other ASCII characters delimit; only words whose share differs clearly
between the positive and the other fitted texts) is trained from confirmed toxic texts
and unlabelled texts with the class-prior-corrected risk

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-)),

whose second part is kept from going below zero.  Documents not labelled
toxic count as unlabelled; the prior is the toxic share of the labelled rows.

The fit uses at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` documents (those
of smallest id hash), which bounds what the driver gets; labels are only read
where ``learnable(doc_id)`` holds.  Every document is scored from its whole text.

Defined results: a null or empty text has no words and gets the score of the
bias alone; a null doc_id is never learnt from; repeated rows are scored row
by row; without toxic labels every score is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm import textscan as ts
from retort.llm.common import texts

MAX_POSITIVE, MAX_UNLABELLED = 5_000, 15_000
MIN_DOCUMENTS = 3  # a word of the model occurs in this many of the fitted documents
MAX_WORDS = 20_000
MIN_Z = 5.0
STEPS, RATE, DECAY = 300, 0.05, 2e-4


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def word_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct words of each text."""
    h, rows = ts.folded_words(buf, off)
    if not len(h):
        return h, rows
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))
    return h[new], rows[new]


def _examples(docs: DataFrame, ids: DataFrame) -> list[tuple[int, np.ndarray]]:
    """(toxic flag, word hashes) of the documents in ``ids``, a bounded table."""
    def run(batches):
        for batch in batches:
            buf, off = ts.text_bytes(batch.column(1))
            out = []
            for lo, hi in ts.slices(off):
                h, rows = word_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                at = ts.word_offsets(rows, hi - lo)
                out += [h[at[i]:at[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.binary())], names=["positive", "words"])

    chosen = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "positive")
    rows = chosen.mapInArrow(run, "positive int, words binary").toPandas()
    return [(int(p), np.frombuffer(w, ts.U)) for p, w in zip(rows["positive"], rows["words"])]


class Model:
    """Sorted word hashes with their weights, and a bias (None: never toxic)."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float | None):
        self.words, self.weights, self.bias = words, weights, bias

    def scores(self, column) -> np.ndarray:
        buf, off = ts.text_bytes(column)
        z = np.zeros(len(off) - 1)
        if self.bias is None:
            return z
        for lo, hi in ts.slices(off):
            h, rows = word_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            if len(h) and len(self.words):
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                hit = self.words[at] == h
                z[lo:hi] = np.bincount(rows[hit], self.weights[at[hit]], hi - lo)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def telling(col, in_positive, count, n_pos, n) -> np.ndarray:
    """Words whose share among the positive rows differs from that among the others by ``MIN_Z`` deviations."""
    pos = np.bincount(col[in_positive], minlength=len(count))
    share = count / n
    z = (pos / n_pos - (count - pos) / (n - n_pos)) / np.sqrt(share * (1 - share) * (1 / n_pos + 1 / (n - n_pos)) + 1e-12)
    z[count < MIN_DOCUMENTS] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:MAX_WORDS]
    return np.sort(best[np.abs(z[best]) >= MIN_Z])


def train(examples: list[tuple[int, np.ndarray]], prior: float) -> Model:
    """Minimise the non-negative risk with logistic loss by full-batch Adam steps."""
    positive = np.array([p for p, _ in examples], bool)
    sizes = np.array([len(w) for _, w in examples], np.int64)
    every = np.concatenate([w for _, w in examples]) if examples else np.zeros(0, ts.U)
    if not positive.any() or positive.all() or not len(every):
        return Model(np.zeros(0, ts.U), np.zeros(0), None)
    words, col, count = np.unique(every, return_inverse=True, return_counts=True)
    often = telling(col, positive[np.repeat(np.arange(len(examples)), sizes)], count, int(positive.sum()), len(examples))
    number = np.full(len(words), -1)
    number[often] = np.arange(len(often))
    row, col = np.repeat(np.arange(len(examples)), sizes), number[col]
    row, col = row[col >= 0], col[col >= 0]
    n, d = len(examples), len(often)
    share_p, share_u = positive / positive.sum(), ~positive / (~positive).sum()
    w, bias = np.zeros(d), 0.0
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], n) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # slope of the loss of calling a row toxic that is not
        loss = np.logaddexp(0, z)
        negative = share_u @ loss - prior * (share_p @ loss)
        if negative >= 0:
            g = prior * share_p * (s - 1) + (share_u - prior * share_p) * s
        else:  # the corrected part went below zero: step back from it
            g = -(share_u - prior * share_p) * s
        gw, gb = np.bincount(col, g[row], d) + DECAY * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return Model(words[often], w, float(bias))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Choose the bounded examples, gather their word sets and train."""
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
            .where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = rows.agg(F.avg("toxic").alias("prior")).first()
    prior = float(total["prior"] or 0.0)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = rows.where("toxic = 1").select("doc_id")
    pos = toxic.orderBy(*by_hash).limit(MAX_POSITIVE)
    unl = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
           .where(learnable(F.col("doc_id"))).distinct().join(toxic, "doc_id", "left_anti")
           .orderBy(*by_hash).limit(MAX_UNLABELLED))
    ids = pos.withColumn("positive", F.lit(1)).unionByName(unl.withColumn("positive", F.lit(0)))
    return train(_examples(docs, ids), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            s = m.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
