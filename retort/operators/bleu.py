"""Corpus BLEU (one reference per segment) as DataFrame aggregations.

Tokenisation follows the public '13a' rules of the common BLEU tool:
unescape a few entities, split punctuation/symbols off, split '.'/','
unless next to a digit, split '-' after a digit, collapse whitespace.
Both sides of a segment stand in one row, so their n-grams are matched in
place, whole Arrow batches at a time; nothing is exploded and only the sums
are exchanged.  Smoothing: 'exp'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 13a tokenizer's substitutions (pattern, replacement), in order.
TOKENIZE_13A = [
    (r"([\x7b-\x7e\x5b-\x60\x20-\x26\x28-\x2b\x3a-\x40\x2f])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
MAX_ORDER = 4


def tokenize_13a(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    x = F.replace(x, F.lit("<skipped>"), F.lit(""))
    x = F.replace(x, F.lit("-\n"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    for a, b in [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pat, rep in TOKENIZE_13A:
        x = F.regexp_replace(x, pat, rep)
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.filter(F.split(x, " "), lambda t: t != "")


def _clipped(hyp, ref):
    """Per row: for n = 1..4 the size of the multiset intersection of both sides' n-grams.

    All tokens of a batch are numbered together; an n-gram's number follows
    from that of its first n - 1 tokens and its last one.  Both sides' (row,
    gram) keys are sorted once with their counts and merged.
    """
    import numpy as np
    import pyarrow as pa

    def flat(column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return column.flatten(), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)

    sides = [flat(c) for c in (hyp, ref)]
    n_rows, n_hyp = len(hyp), len(sides[0][0])
    tokens = pa.concat_arrays([x for x, _ in sides]).dictionary_encode()
    first = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(tokens.dictionary) + 1
    # rows 0.. are hypotheses, rows n_rows.. their references
    row = np.repeat(np.arange(2 * n_rows), np.concatenate([np.diff(o) for _, o in sides]))
    out, gram = np.zeros((n_rows, MAX_ORDER), np.int64), first
    for n in range(1, MAX_ORDER + 1):
        if n > 1:
            _, gram = np.unique(gram[:-1] * width + first[n - 1:], return_inverse=True)
        inside = row[:len(gram)] == row[n - 1:]
        at, g = row[:len(gram)][inside], gram[inside]
        if not len(g):
            break
        left = at < n_rows
        size = int(g.max()) + 1
        (a, count_a), (b, count_b) = (np.unique(r * size + x, return_counts=True)
                                      for r, x in ((at[left], g[left]), (at[~left] - n_rows, g[~left])))
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        np.add.at(out[:, n - 1], both // size, np.minimum(count_a[i], count_b[j]))
    return pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1, dtype=np.int32) * MAX_ORDER), pa.array(out.ravel()))


def bleu_stats(pairs: DataFrame, key: list, hyp: str, ref: str) -> DataFrame:
    """One row: sys_len, ref_len, total_1..4, correct_1..4.

    Both sides of a segment are in one row, so their n-grams are matched there
    (one Arrow pass over the tokens); only the final sums leave their task.
    ``key`` names the segments; rows are segments, also where a key repeats.
    """
    none = F.array().cast("array<string>")
    t = pairs.select(*[F.coalesce(tokenize_13a(F.trim(F.col(c))), none).alias(o) for c, o in ((hyp, "__h"), (ref, "__r"))])
    t = t.select(F.size("__h").cast("long").alias("h"), F.size("__r").cast("long").alias("r"),
                 F.arrow_udf(_clipped, "array<long>")("__h", "__r").alias("m"))
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(c), zero)
    return t.agg(total(F.col("h")).alias("sys_len"), total(F.col("r")).alias("ref_len"),
                 *[total(F.greatest(F.col("h") - (n - 1), zero)).alias(f"total_{n}") for n in range(1, MAX_ORDER + 1)],
                 *[total(F.col("m")[n - 1]).alias(f"correct_{n}") for n in range(1, MAX_ORDER + 1)])


def bleu_score(stats: DataFrame) -> DataFrame:
    """Score 0..100 from the statistics row ('exp' smoothing, brevity penalty); 0 when no n-gram of any order matches."""
    sys_len, ref_len = F.col("sys_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(sys_len < ref_len, F.when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(F.lit(0.0))) \
        .otherwise(F.lit(1.0))
    logs = []
    smooth = F.lit(1.0)
    alive = F.lit(True)  # false once an order has no n-grams at all (then p = 0)
    for n in range(1, MAX_ORDER + 1):
        tot, cor = F.col(f"total_{n}").cast("double"), F.col(f"correct_{n}").cast("double")
        alive = alive & (tot > 0)
        smooth = F.when(alive & (cor == 0), smooth * 2).otherwise(smooth)
        p = F.when(~alive, F.lit(0.0)).when(cor == 0, 100.0 / (smooth * tot)).otherwise(100.0 * cor / tot)
        logs.append(F.when(p == 0, F.lit(-9999999999.0)).otherwise(F.log(p)))
    matched = sum((F.col(f"correct_{n}") for n in range(2, MAX_ORDER + 1)), F.col("correct_1"))
    score = F.when((sys_len == 0) | (matched == 0), F.lit(0.0)).otherwise(bp * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4))
    return stats.withColumn("bleu", score)


def corpus_bleu(pairs: DataFrame, key: list, hyp: str, ref: str) -> DataFrame:
    return bleu_score(bleu_stats(pairs, key, hyp, ref))


