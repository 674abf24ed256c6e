"""Importance resampling towards a target distribution, with segment deduplication.

Newlines separate words, so they cut a text into lines.  Equal lines of the
corpus and the target are brought together first; the hashed n-gram counts of
every different line are computed once and multiplied by its occurrences in
each.  N-grams that reach over a line's end belong to no line: they are
counted with their document and added separately.  A document's weight is the sum of its lines' weights, each
computed once too, and of its own n-grams over line ends.

Words are runs of digits, ASCII letters (A-Z taken as a-z) and all characters
beyond ASCII; a feature is a run of 1 to ``max_n`` words joined by one blank;
its bucket is the CRC-32 of its bytes modulo ``buckets``.  A bucket's gain is
the logarithm of its smoothed share in the target over that in the corpus,
in thousandths; the score adds seeded Gumbel noise, so taking the highest
scores draws without replacement in proportion to the weights.

Plan: one exchange of the lines that differ inside a batch; one join of line
keys (16 bytes) with line weights and one sum per document, of narrow rows; a
line that a third of all documents hold is combined before the exchange, and
its join can be split, since both sides are written tables.  Ranks come from
positions inside score ranges.  Only the ``buckets`` counts reach the driver.

Defined results: a null text has no words; a document without words has
weight 0; repeated rows are scored one by one, and of equal scores the smaller
doc_id is drawn first; a null doc_id is drawn after the others of its score,
its noise that of an empty id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm import textscan as ts
from retort.plans.rowindex import global_index
from retort.session import checkpoint_dir, drop_path, stage_path

MAX_N, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10

#: Bytes that are no part of a word: ASCII but digits and small letters (texts are lower-cased first).
_GAP = np.zeros(256, bool)
_GAP[[c for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)]] = True


# ------------------------------------------------------------------ features of a batch of texts

def _word_ids(buf, starts, ends, h) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word's spelling, CRC-32 by number, spelling by number)."""
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    names = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    return ids, np.array([zlib.crc32(w) for w in names], np.int64), names


def features(column, max_n: int, buckets: int, across: bool):
    """(number of words by text, text of each feature, its bucket).

    ``across``: only the features of two and more words that reach over a
    newline; otherwise all features (of texts without newlines).
    """
    buf, off = ts.text_bytes(column)
    buf = ts._LOWER[buf]
    words = np.zeros(len(off) - 1, np.int64)
    rows_out, buckets_out = [], []
    for lo, hi in ts.slices(off):
        part = buf[off[lo]:off[hi]]
        starts, ends, rows, h = ts.words(part, off[lo:hi + 1] - off[lo], _GAP)
        words[lo:hi] = np.bincount(rows, minlength=hi - lo)
        if not len(starts) or across and max_n < 2:
            continue
        line = np.cumsum(part == 10)[starts] if across else None
        ids, code, names = _word_ids(part, starts, ends, h)
        crc, gram = code[ids], ids
        if not across:
            rows_out.append(rows + lo)
            buckets_out.append(crc % buckets)
        for n in range(2, max_n + 1):
            m = len(rows) - n + 1
            if m <= 0:
                break
            # a gram is the gram of one word less and the word behind it: both are numbered, so it gets a number too
            pair = gram[:m] * len(names) + ids[n - 1:]
            _, first, gram = np.unique(pair, return_index=True, return_inverse=True)
            longer = np.array([zlib.crc32(b" " + names[w], int(c)) for c, w in zip(crc[:m][first], ids[n - 1:][first])], np.int64)
            crc = longer[gram]
            keep = rows[:m] == rows[n - 1:]
            if across:
                keep &= line[:m] != line[n - 1:]
            rows_out.append(rows[:m][keep] + lo)
            buckets_out.append(crc[keep] % buckets)
    if not rows_out:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return words, np.concatenate(rows_out), np.concatenate(buckets_out)


def _sparse(rows: np.ndarray, bucket: np.ndarray, n: int, buckets: int):
    """Bucket counts by row as two list arrays behind the same offsets."""
    key, count = np.unique(rows * buckets + bucket, return_counts=True)
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * buckets).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (key % buckets, count)]
    return lists, at


def _lines(column):
    """(lines of all texts, offsets by text), A-Z in lower case; a null text is one empty line."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.split_pattern(pc.ascii_lower(pc.fill_null(column, "")), "\n")
    return lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64)


# ------------------------------------------------------------------ tables

def distinct_lines(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(line, n, t): every different non-empty line and its occurrences in both; equal lines of a batch are combined first."""
    def cut(batches):
        for b in batches:
            enc = _lines(b.column(0))[0].dictionary_encode()
            n = np.bincount(enc.indices.to_numpy(), minlength=len(enc.dictionary)).astype(np.int64)
            keep = pc.greater(pc.binary_length(enc.dictionary), 0)
            yield pa.RecordBatch.from_arrays([enc.dictionary.filter(keep), pa.array(n).filter(keep)], ["line", "n"])

    here, there = (x.select("text").mapInArrow(cut, "line string, n long") for x in (docs, target))
    none = F.lit(0).cast("long")
    both = here.withColumn("t", none).unionByName(there.select("line", none.alias("n"), F.col("n").alias("t")))
    return both.groupBy("line").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def line_features(lines: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(key, n, t, n_words, n_features, bucket, count): the features of every different line, computed once."""
    def run(batches):
        for b in batches:
            words, rows, bucket = features(b.column("line"), max_n, buckets, False)
            (ids, counts), _ = _sparse(rows, bucket, b.num_rows, buckets)
            keys = [hashlib.md5(x.encode()).digest() for x in b.column("line").to_pylist()]
            total = np.bincount(rows, minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("n"), b.column("t"), pa.array(words),
                                              pa.array(total), ids, counts],
                                             ["key", "n", "t", "n_words", "n_features", "bucket", "count"])

    return lines.mapInArrow(run, "key binary, n long, t long, n_words long, n_features long, bucket array<int>, count array<int>")


def document_rows(docs: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(row, doc_id, keys, bucket, count): a number for every row, its lines' keys and its features over line ends.

    The numbers hold once the table is written: of a task that ran twice one result is kept.
    """
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            lines, off = _lines(b.column("text"))
            enc = lines.dictionary_encode()
            names = [hashlib.md5(x.encode()).digest() if x else None for x in enc.dictionary.to_pylist()]
            keys = pa.array(names, pa.binary()).take(enc.indices)
            keep = keys.is_valid()
            at = np.append(0, np.cumsum(keep.to_numpy(zero_copy_only=False)))[off]
            _, rows, bucket = features(b.column("text"), max_n, buckets, True) if max_n > 1 else (None, *[np.zeros(0, np.int64)] * 2)
            (ids, counts), _ = _sparse(rows, bucket, b.num_rows, buckets)
            number = np.arange(row, row + b.num_rows, dtype=np.int64)
            row += b.num_rows
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), keys.filter(keep))
            yield pa.RecordBatch.from_arrays([pa.array(number), b.column("doc_id"), lists, ids, counts],
                                             ["row", "doc_id", "keys", "bucket", "count"])

    return docs.mapInArrow(run, "row long, doc_id long, keys array<binary>, bucket array<int>, count array<int>")


def bucket_counts(*tables: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Features by bucket, in the corpus and in the target, over tables of (n, t, bucket, count): summed in every task first."""
    def run(batches):
        total = np.zeros((buckets, 2), np.int64)
        for b in batches:
            bucket = b.column("bucket").flatten().to_numpy()
            size, count = b.column("bucket").value_lengths().to_numpy(), b.column("count").flatten().to_numpy()
            for k in (0, 1):
                np.add.at(total[:, k], bucket, count * np.repeat(b.column(k).to_numpy(), size))
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, k]) for k in (0, 1)]], ["bucket", "n", "t"])

    out: tuple = ([0] * buckets, [0] * buckets)
    for x in tables:
        sums = x.select("n", "t", "bucket", "count").mapInArrow(run, "bucket int, n long, t long")
        for r in sums.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():
            out[0][r["bucket"]] += r["n"]
            out[1][r["bucket"]] += r["t"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the source) of every bucket."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
                     for s, t in zip(source, target)], np.int64)


def weighed(table: DataFrame, gain: np.ndarray, *columns: str) -> DataFrame:
    """``columns`` and ``weight``: the sum of gains over a row's bucket counts."""
    kept = table.select(*columns)

    def run(batches):
        for b in batches:
            size = b.column("bucket").value_lengths().to_numpy()
            part = gain[b.column("bucket").flatten().to_numpy()] * b.column("count").flatten().to_numpy()
            w = ts.per_row(part, np.append(0, np.cumsum(size)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(w)], [*columns, "weight"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return table.select(*columns, "bucket", "count").mapInArrow(run, f"{schema}, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln u)) for a u in (0, 1) that the seed and the id decide."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every document.

    ``target``: any table with a column ``text``.  Of the documents with at
    least ``least_words`` words ``percent`` in a hundred are drawn.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    folder = stage_path(spark, f"resample-{uuid.uuid4().hex}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def stored(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    lines = stored(line_features(distinct_lines(docs, target), max_n, buckets), "lines")
    rows = stored(document_rows(docs, max_n, buckets), "rows")
    tables = [lines]
    if max_n > 1:  # where a feature is one word, none reaches over a line's end
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        there = document_rows(target.select(none.alias("doc_id"), "text"), max_n, buckets)
        tables += [rows.withColumns({"n": one, "t": none}), there.withColumns({"n": none, "t": one})]
    gain = gains(*bucket_counts(*tables, buckets=buckets))
    zero = F.lit(0).cast("long")
    if max_n > 1:
        counted = rows.withColumn("n_features", F.aggregate("count", zero, lambda a, c: a + c))
        own = weighed(counted, gain, "row", "doc_id", "n_features").withColumn("n_words", zero)
    else:
        own = rows.select("row", "doc_id", zero.alias("n_features"), zero.alias("weight"), zero.alias("n_words"))
    held = (rows.select("row", "doc_id", F.explode("keys").alias("key"))
            .join(weighed(lines, gain, "key", "n_words", "n_features"), "key"))
    sums = (held.select(own.columns).unionByName(own).groupBy("row", "doc_id")
            .agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]))
    scored = sums.select("row", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
                         (F.col("n_words") >= least_words).alias("long_enough"))
    placed = global_index(scored, [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], by=["long_enough"],
                          index_col="place", total_col="total")
    drawn = F.col("long_enough") & (F.col("place") < F.floor(F.col("total") * percent / F.lit(100)))
    drop_path(spark, folder)  # the positions come from a checkpoint
    return placed.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(drawn, F.col("place") + 1).cast("long").alias("rank"))
