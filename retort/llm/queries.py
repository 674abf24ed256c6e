"""One query for each operator: it applies the operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import (chatlogs, decontaminate, htmltext, packing, qualify, resample, reshard, secrets, setjoin, substrings,
                        toxicity, vectorcodes, warc)
from retort.llm.common import table

QUERIES: dict = {}
SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = qualify.fit(docs, table(spark, sf_dir, "labels"))
    return qualify.score(docs, weights)


@query
def op2_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op2_maximal_repeats"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
r AS (SELECT g.doc_id, g.i FROM g JOIN m ON g.s = m.s WHERE m.least < g.doc_id),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS fresh
      FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
parts AS (SELECT cuts.doc_id, before AS pos, substr(x, 2 * before + 1, 2 * (a - before)) AS part FROM cuts JOIN d USING (doc_id)
          UNION ALL
          SELECT d.doc_id, coalesce(e, 0), substr(x, 2 * coalesce(e, 0) + 1)
          FROM d LEFT JOIN (SELECT doc_id, max(b) AS e FROM spans GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY pos) AS x FROM parts GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


@query
def op3_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps each source in one of 12 shards, so one of them is very full."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(12))
    return (reshard.reshard(docs, old)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved"))


@query
def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked(table(spark, sf_dir, "documents"))


SQL["op4_chosen_path_join"] = """
WITH RECURSIVE t AS (
    SELECT text, min(doc_id) AS rep, count(*) AS n_copies,
           regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
s AS (SELECT DISTINCT rep, array_to_string(w[i + 1:i + 5], ' ') AS g
      FROM (SELECT rep, w, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM t)),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c)),
c AS (SELECT rep AS a, rep AS b FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
k AS (SELECT a AS rep, min(b) AS class_id FROM c GROUP BY a),
l AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, k.class_id, t.n_copies, coalesce(l.n_links, 0) AS n_links
FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN k USING (rep) LEFT JOIN l USING (rep)
"""


@query
def op5_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op6_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
                        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op9_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(~toxicity.learnable(F.col("doc_id")), F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlogs.collapse(table(spark, sf_dir, "conversations"))


SQL["op10_chat_snapshots"] = """
WITH t AS (SELECT conv_id, list(coalesce(role, 'user') || chr(0) || coalesce(text, '') ORDER BY turn) AS v,
                  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10),
                             '' ORDER BY turn) AS rendered
           FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT v[1:n] AS v FROM (SELECT v, unnest(range(1, len(v))) AS n FROM t)),
u AS (SELECT v, min(conv_id) AS conv_id, count(*) AS n_copies FROM t GROUP BY v)
SELECT u.conv_id, CAST(len(u.v) AS BIGINT) AS n_turns, u.n_copies, t.rendered
FROM u JOIN t USING (conv_id) WHERE u.v NOT IN (SELECT v FROM p)
"""


@query
def op11_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(codebooks)).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds by brute force: every part against every entry, in whole numbers."""
    near = """SELECT v.vec_id, v.p, v.v, min(struct_pack(d := list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS n
              FROM parts v JOIN c{k} c ON c.p = v.p GROUP BY ALL"""
    steps = "".join(f"""
n{k} AS ({near.format(k=k)}),
m{k} AS (SELECT p, n.e AS e, i, sum(v[i]) AS s, count(*) AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM n{k}) GROUP BY ALL),
c{k + 1} AS (SELECT c.p, c.e, coalesce(u.v, c.v) AS v
        FROM c{k} c LEFT JOIN (SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS v FROM m{k} GROUP BY p, e) u
        ON c.p = u.p AND c.e = u.e),""" for k in range(rounds))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v
          FROM (SELECT *, unnest(range(0, {parts})) AS p FROM kept)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT p, e, v FROM parts JOIN seeds USING (vec_id)),{steps}
last AS ({near.format(k=rounds)}),
codes AS (SELECT vec_id, string_agg(lpad(lower(to_hex(n.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error
          FROM last GROUP BY vec_id),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM codes JOIN kept USING (vec_id) GROUP BY label),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id) JOIN sums ON sums.label IS NOT DISTINCT FROM kept.label CROSS JOIN book
"""


SQL["op11_dual_tree_codes"] = _codes_sql()


@query
def op12_line_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op12_line_resample"] = r"""
WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b) ORDER BY b) AS t
        FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS b)),
x AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT kind, id, unnest(w) AS w FROM w),
u AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1)
                               + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS b
      FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM f)),
v AS (SELECT w, xor(4294967295, list_reduce(b, lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), CAST(4294967295 AS BIGINT))) % 10000 AS bucket
      FROM u CROSS JOIN crc),
n AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN v USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM n) + 10000) AS DOUBLE)
                                          / CAST((s + 1) * ((SELECT sum(t) FROM n) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n),
d AS (SELECT id AS doc_id, len(w) AS n_features, ('0x' || sha256('2024:' || id)[1:8])::BIGINT AS h FROM w WHERE kind = 0),
a AS (SELECT id AS doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN v USING (w) JOIN g USING (bucket) WHERE kind = 0 GROUP BY id),
s AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN a USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM s LEFT JOIN r USING (doc_id)
"""


@query
def op13_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op13_zstd_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p WHERE octet_length(x) >= 100 GROUP BY x)
SELECT page_id, octet_length(x) AS payload_bytes, sha256(x) AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (x)
"""
