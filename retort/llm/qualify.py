"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Words and word pairs fall into a fixed number of hash buckets.  Two
multinomials over the buckets are estimated: the *raw* one from every
document, the *target* one from documents labelled as good.  A document's
score is the mean log ratio of its n-grams, so it does not depend on length;
a document is kept when the score reaches a fixed threshold and the base
rules (enough words, not mostly repeated word triples) hold.

Trusted documents are found by a join on their ids, so all of them count.
Driver memory and the model's broadcast are fixed: one weight per bucket.

Defined results: a null text is empty; an empty text has no words, fails the
base rules and gets a null score; repeated rows are judged row by row and
count as often as they occur; without trusted documents every score is 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm import textscan as ts
from retort.llm.common import texts

BUCKETS = 1 << 14
SMOOTHING = 20.0  # counts added to a bucket on both sides: little evidence means a ratio near one
THRESHOLD = -0.06  # nats per n-gram
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
UNIT = 1_000_000  # weights are whole millionths, so sums do not depend on their order

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCORE_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                "base_failed boolean, llr double, kept boolean")


def ngram_buckets(h: np.ndarray, rows: np.ndarray, buckets: int = BUCKETS):
    """(bucket, row) of every word and every word pair."""
    pairs, at = ts.ngrams(h, rows, 2)
    b = np.concatenate([h, pairs]) % ts.U(buckets)
    return b.astype(np.int64), np.concatenate([rows, rows[at]])


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``texts(docs)`` and whether the document is labelled good.

    The texts are exchanged once and meet their share of the ids, which alone
    are held; so the plan is the same for any number of ids, and a hot document
    id can be split.
    """
    good = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            .withColumn("good", F.lit(True)).hint("shuffle_hash"))
    return texts(docs).join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket, in millionths.  One pass over all documents."""
    def count(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            buf, off = ts.text_bytes(batch.column(1))
            good = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in ts.slices(off):
                piece, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                _, _, rows, h = ts.words(piece, o)
                b, r = ngram_buckets(h, rows, buckets)
                total[0] += np.bincount(b, minlength=buckets)
                total[1] += np.bincount(b[good[lo + r]], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])],
                                         names=["bucket", "raw", "target"])

    rows = (with_trust(docs, labels).mapInArrow(count, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(buckets, np.int64)
    expected = raw * (target.sum() / raw.sum())
    return np.rint(UNIT * np.log((target + SMOOTHING) / (expected + SMOOTHING))).astype(np.int64)


def _base(piece: np.ndarray, off: np.ndarray):
    """Base figures of the texts of one slice, and their word hashes and rows."""
    n = len(off) - 1
    starts, ends, rows, h = ts.words(piece, off)
    wo = ts.word_offsets(rows, n)
    lead = np.zeros(len(piece) + 1, np.int64)
    np.cumsum((piece & 0xC0) != 0x80, out=lead[1:])
    chars = ts.per_row(lead[ends] - lead[starts], wo)
    symbols = ts.per_row(_SYMBOL[piece], off)
    grams, at = ts.ngrams(h, rows, 3)
    covered = np.zeros(len(h) + 2, bool)
    if len(grams):
        key = ts.mix(grams + rows[at].astype(ts.U) * ts.U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    repeats = ts.per_row(covered[:len(h)], wo)
    dup = np.zeros(n, np.int64)
    for i in np.flatnonzero(ts.per_row(piece == 10, off)):
        lines = [x for x in piece[off[i]:off[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        dup[i] = len(lines) - len(set(lines))
    return np.diff(wo), chars, symbols, dup, repeats, h, rows


def judge(column, weights: np.ndarray, threshold: float = THRESHOLD) -> dict:
    """All figures and the verdict for one Arrow column of texts, as arrays by name."""
    buf, off = ts.text_bytes(column)
    parts = []
    for lo, hi in ts.slices(off):
        n_words, chars, symbols, dup, repeats, h, rows = _base(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        b, r = ngram_buckets(h, rows, len(weights))
        sums = np.bincount(r, weights[b].astype(float), hi - lo)  # whole numbers below 2**53: exact
        parts.append((n_words, chars, symbols, dup, repeats, sums, np.bincount(r, minlength=hi - lo)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "sums", "n_grams")
    out = {k: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i, k in enumerate(names)}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["llr"] = out["sums"] / np.maximum(out["n_grams"], 1) / UNIT
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: base figures, score and verdict."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            x = judge(batch.column(1), model.value, threshold)
            cols = [batch.column(0)] + [pa.array(x[k], pa.int64()) for k in
                                        ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            cols += [pa.array(x["base_failed"]), pa.array(x["llr"], pa.float64(), mask=x["n_grams"] == 0),
                     pa.array(x["kept"])]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCORE_SCHEMA.split(", ")])

    return texts(docs).mapInArrow(run, SCORE_SCHEMA)


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is kept."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at), model.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)
