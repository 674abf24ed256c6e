"""Round-trip checks for sources and sinks (derived tables written under the checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.operators import metrics as mt
from retort.operators import filters as fl
from retort.plans import corpora
from retort.plans.rowindex import global_index, split_train_valid_test, written
from retort.schema import CLEAN_REACTIONS
from retort.sources import io
from retort.sources import testdata as td
from retort.suite import register
from retort.suite.reactions import BASE, FWD, SQL_FWD_BASE, clean, SQL_COMPOUNDS
from retort.functions import smiles as sm
from retort.operators.compounds import distinct_compounds
from retort.suite import sqlbits as q
from retort.suite import tokens as tks

W = td.with_sql


@register("scan_tsv_named", W(td.SQL_RAW_REACTIONS) + " SELECT id, input, product, condition FROM fx_raw_reactions")
def _scan_tsv(spark, sf):
    path = io.scratch(spark, "raw-tsv")
    io.sink_tsv(td.raw_reactions(spark, sf).select("id", "input", "product", "condition"), path)
    return io.scan_tsv_named(spark, path)


@register("scan_csv", W(*BASE) + " SELECT CATALYST, REACTANT, REAGENT, SOLVENT, INTERNAL_STANDARD, NoData, PRODUCT, YIELD, TEMP FROM fx_clean")
def _scan_csv(spark, sf):
    path = io.scratch(spark, "clean-csv")
    io.sink_csv(clean(spark, sf).drop("row_id"), path)
    return io.scan_csv(spark, path, CLEAN_REACTIONS)


@register("sink_csv", W(*BASE, SQL_FWD_BASE) + " SELECT CATALYST, REACTANT, REAGENT, SOLVENT, PRODUCT, row_id FROM fx_fwd_base")
def _sink_csv(spark, sf):
    df = fl.fill_blank_roles(fl.require_not_null(clean(spark, sf), ["PRODUCT"]),
                             ["CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT"])
    df = df.select("CATALYST", "REACTANT", "REAGENT", "SOLVENT", "PRODUCT", "row_id")
    path = io.scratch(spark, "blank-csv")
    io.sink_csv(df, path)
    return io.scan_csv(spark, path, df.schema)


@register("scan_lines", W(*BASE, SQL_COMPOUNDS) + " SELECT smiles FROM fx_compounds")
def _scan_lines(spark, sf):
    path = io.scratch(spark, "lines")
    distinct_compounds(clean(spark, sf)).write.mode("overwrite").text(path)
    return io.scan_lines(spark, path, "smiles")


@register("scan_smi_parts", W(*BASE, SQL_COMPOUNDS) + f"""
 SELECT DISTINCT {q.canonical('smiles')} AS smiles
 FROM fx_compounds WHERE {q.is_valid('smiles')}""")
def _scan_smi(spark, sf):
    path = io.scratch(spark, "smi")
    comp = distinct_compounds(clean(spark, sf))
    parts = comp.select("smiles", F.concat(F.lit("ZINC"), F.abs(F.xxhash64("smiles")).cast("string")).alias("zinc_id"))
    parts.repartition(4).write.mode("overwrite").option("header", True).option("sep", " ").csv(path)
    read = io.scan_smi_parts(spark, path + "/*.csv", "smiles")
    # unreadable molecules are skipped, the rest canonicalised and deduplicated
    ok = read.where(sm.is_valid_smiles("smiles"))
    return ok.select(sm.canonical_fragments("smiles").alias("smiles")).distinct()


@register("scan_by_extension", " SELECT conv_id, turn, role, text FROM conversations")
def _scan_ext(spark, sf):
    path = io.scratch(spark, "conv") + ".json"
    td.table(spark, sf, "conversations").write.mode("overwrite").json(path)
    return io.scan_by_extension(spark, path, "conv_id long, turn long, role string, text string")


@register("scan_by_extension_csv", W(*BASE) + " SELECT row_id, REACTANT, REAGENT, PRODUCT, YIELD FROM fx_clean")
def _scan_ext_csv(spark, sf):
    """Role columns with blanks, quotes and nulls in a headed CSV file, chosen by its suffix."""
    path = io.scratch(spark, "roles") + ".csv"
    df = clean(spark, sf).select("row_id", "REACTANT", "REAGENT", "PRODUCT", "YIELD")
    io.sink_csv(df, path)
    return io.scan_by_extension(spark, path, df.schema)


@register("scan_by_extension_txt", W(*BASE, SQL_COMPOUNDS) + " SELECT smiles AS text FROM fx_compounds")
def _scan_ext_txt(spark, sf):
    path = io.scratch(spark, "lines") + ".txt"
    distinct_compounds(clean(spark, sf)).write.mode("overwrite").text(path)
    return io.scan_by_extension(spark, path)


@register("sink_csv_splits", W(*FWD) + """
 , ranked AS (SELECT row_id, REACTANT, REAGENT, PRODUCT, row_number() OVER (ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) - 1 AS idx,
                     count(*) OVER () AS n FROM fx_fwd)
 SELECT row_id, REACTANT, REAGENT, PRODUCT, CASE WHEN idx < floor(n * 0.1) THEN 'test' ELSE 'valid' END AS part
 FROM ranked WHERE idx < 2 * floor(n * 0.1)""")
def _sink_csv_splits(spark, sf):
    """The split corpus in one folder a split; the test and validation folders are read back alone."""
    fwd = written(corpora.forward_corpus(clean(spark, sf)).select("row_id", "REACTANT", "REAGENT", "PRODUCT"))
    path = io.scratch(spark, "splits")
    io.sink_csv(split_train_valid_test(fwd, ["row_id"], seed=42, frac=0.1).select(*fwd.columns, "split"), path, split_col="split")
    parts = [io.scan_split(spark, path, fwd.schema, "split", v).withColumn("part", F.lit(v)) for v in ("test", "valid")]
    return parts[0].unionByName(parts[1])


@register("pick_text_column", " SELECT text FROM benchmark")
def _pick_text(spark, sf):
    return io.pick_text_column(td.table(spark, sf, "benchmark"))


@register("sink_arrays", " SELECT vec_id, embedding, CAST((len(embedding) + 7) // 8 AS INTEGER) AS n_rows FROM embeddings")
def _sink_arrays(spark, sf):
    """Whole vectors as matrices of eight numbers a row, written, read back and laid flat again."""
    path = io.scratch(spark, "arrays")
    m = td.table(spark, sf, "embeddings").select("vec_id", io.as_matrix("embedding", 8).alias("vectors"))
    io.sink_arrays(m, path)
    back = io.read_arrays(spark, path, m.schema)
    return back.select("vec_id", F.flatten("vectors").alias("embedding"), F.size("vectors").alias("n_rows"))


@register("score_batches", W(td.SQL_SCORES) + """
 SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 32 AS BIGINT) AS batch,
        CAST((row_number() OVER (ORDER BY id) - 1) % 32 AS INTEGER) AS pos, [1.0 - score, score] AS score FROM fx_scores""")
def _score_batches(spark, sf):
    s = td.scores_fx(spark, sf)
    x = global_index(s, ["id"], total_col=None)
    x = x.withColumn("batch", F.floor(F.col("idx") / 32).cast("long"))
    item = F.struct(F.col("idx"), F.array(F.lit(1.0) - F.col("score"), F.col("score")).alias("v"))
    batches = x.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("__s"))  # at most 32 rows per batch
    batches = batches.select("batch", F.transform("__s", lambda t: t["v"]).alias("scores"))
    path = io.scratch(spark, "batches")
    batches.write.mode("overwrite").parquet(path)
    return io.flatten_score_batches(spark.read.parquet(path))


@register("sink_metrics_json", W(td.SQL_REGRESSION) + """
 SELECT sse / n AS eval_mse, sqrt(sse / n) AS eval_rmse, 1 - sse / (vp * n) AS eval_r2, n AS eval_n
 FROM (SELECT sum((y - p) * (y - p)) AS sse, count(*) AS n, var_pop(y) AS vp FROM fx_regression)""")
def _sink_metrics(spark, sf):
    m = mt.regression_metrics(td.regression_fx(spark, sf), "y", "p")
    path = io.scratch(spark, "metrics")
    io.sink_metrics_json(m, path)
    return spark.read.schema("eval_mse double, eval_rmse double, eval_r2 double, eval_n long").json(path)


@register("vocab_io", W(tks.SQL_VOCAB) + " SELECT token, CAST(id AS BIGINT) AS id FROM fx_vocab")
def _vocab_io(spark, sf):
    path = io.scratch(spark, "vocab")
    io.write_vocab(tks.vocab_df(spark, sf), path)
    return io.read_vocab(spark, path)


@register("merges_io", W(tks.SQL_MERGES) + " SELECT CAST(rank AS INTEGER) AS rank, a AS first, b AS second FROM pairs")
def _merges_io(spark, sf):
    """The most frequent pairs of characters in the order of their ranks, written and read back."""
    pairs = tks.frequent_pairs(tks.pieces_df(spark, sf)).collect()  # at most N_PAIRS rows
    merges = spark.createDataFrame([(i, r["a"], r["b"]) for i, r in enumerate(pairs)], "rank int, first string, second string")
    path = io.scratch(spark, "merges")
    io.write_merges(merges, path)
    return io.read_merges(spark, path)
