"""Checks for pretokenisation, vocabularies, encoding, packing, span corruption, MLM masks, BLEU."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.operators import bleu as bl
from retort.operators import tokenizer as tz
from retort.operators import tokens as tk
from retort.operators.filters import drop_blank_lines
from retort.sources import testdata as td
from retort.suite import register

W = td.with_sql
VOCAB_SIZE = 1000
BPE_MERGES = VOCAB_SIZE - len(tk.SPECIALS) - 256  # the vocabulary less special tokens and bytes
PACK_LEN = 568
N_SENTINELS = 100  # appended to the vocabulary, so that no sentinel is a token
FULL_SIZE = VOCAB_SIZE + N_SENTINELS

_NORM = (f"replace(regexp_replace(regexp_replace(regexp_replace(text, '{tk.NMT_DROP}', '', 'g'), "
         f"'{tk.NMT_SPACE}', ' ', 'g'), ' {{2,}}', ' ', 'g'), ' ', '▁')")

SQL_PIECES = f"""
fx_pieces AS (
  SELECT doc_id, regexp_extract_all(CASE WHEN starts_with(m, '▁') THEN m ELSE '▁' || m END, '{tk.PIECE_PATTERN}') AS pieces
  FROM (SELECT doc_id, {_NORM} AS m FROM documents))"""

SQL_VOCAB = SQL_PIECES + f""",
fx_counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(pieces) AS token FROM fx_pieces) GROUP BY token),
fx_vocab AS (
  SELECT * FROM (VALUES ('<pad>', 0), ('</s>', 1), ('<unk>', 2)) s(token, id)
  UNION ALL
  SELECT token, id FROM (
    SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM fx_counts
    WHERE token NOT IN ('<pad>', '</s>', '<unk>')) WHERE id < {VOCAB_SIZE}),
fx_vmap AS (SELECT map(list(token), list(id)) AS m, map(list(id), list(token)) AS inv FROM fx_vocab),
fx_enc AS (
  SELECT doc_id, list_append(list_transform(pieces, lambda p: CAST(coalesce(m[p], 2) AS INTEGER)), 1) AS input_ids
  FROM fx_pieces, fx_vmap)"""


def pieces_df(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id", "text")
    return tk.pretokenise(docs, "text").select("doc_id", "pieces")


def vocab_df(spark, sf):
    return tk.build_vocab(tk.token_counts(pieces_df(spark, sf)), size=VOCAB_SIZE)


def encoded(spark, sf):
    return tk.encode(pieces_df(spark, sf), "pieces", vocab_df(spark, sf)).select("doc_id", "input_ids")


@register("pretokenise", W(SQL_PIECES) + " SELECT doc_id, pieces FROM fx_pieces")
def _pretokenise(spark, sf):
    return pieces_df(spark, sf)


@register("token_counts", W(SQL_VOCAB) + " SELECT token, n FROM fx_counts")
def _token_counts(spark, sf):
    return tk.token_counts(pieces_df(spark, sf))


@register("vocab_table", W(SQL_VOCAB) + " SELECT token, CAST(id AS BIGINT) AS id FROM fx_vocab")
def _vocab(spark, sf):
    return vocab_df(spark, sf)


@register("encode", W(SQL_VOCAB) + " SELECT doc_id, input_ids FROM fx_enc")
def _encode(spark, sf):
    return encoded(spark, sf)


@register("decode", W(SQL_VOCAB) + """
 , d AS (SELECT doc_id, replace(array_to_string(list_transform(list_filter(input_ids, lambda i: i NOT IN (0, 1, 2)),
           lambda i: inv[i]), ''), '▁', ' ') AS t FROM fx_enc, fx_vmap)
 SELECT doc_id, CASE WHEN starts_with(t, ' ') THEN substr(t, 2) ELSE t END AS text FROM d""")
def _decode(spark, sf):
    return tk.decode(encoded(spark, sf), "input_ids", vocab_df(spark, sf)).select("doc_id", "text")


@register("encode_char", """
 WITH c AS (SELECT unnest(string_split(text, '')) AS token FROM documents),
 v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM (SELECT token, count(*) AS n FROM c GROUP BY token)),
 m AS (SELECT map(list(token), list(id)) AS m FROM v)
 SELECT doc_id, list_concat([0], list_concat(list_transform(list_slice(string_split(text, ''), 1, 510), lambda x: CAST(m[x] AS INTEGER)), [1]))
        AS input_ids FROM documents, m""")
def _encode_char(spark, sf):
    """Character vocabulary, a [start] ... [end] template, and the reference's limit of 512 ids."""
    docs = td.table(spark, sf, "documents").select("doc_id", F.array("text").alias("pieces"))
    chars = docs.select(F.explode(F.split(F.col("pieces")[0], "")).alias("token"))
    vocab = tk.build_vocab(chars.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    tok = tz.Tokenizer.load("char", vocab, prefix=(0,), suffix=(1,))
    return tk.encode(docs, "pieces", tok, max_length=512).select("doc_id", "input_ids")


def byte_pieces(spark, sf):
    from retort.operators import vocab_train as vt
    docs = td.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.regexp_extract_all("text", F.lit(vt.BYTE_LEVEL_SPLIT), 0).alias("pieces"))


def bpe_tokenizer(spark, sf):
    from retort.operators import vocab_train as vt
    merges, _ = vt.train_bpe(vt.byte_level_words(td.table(spark, sf, "documents").select("text"), "text"), num_merges=BPE_MERGES)
    pairs = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    symbols = [tz.CHAR_OF[b] for b in range(256)] + [a + b for a, b in pairs]
    return tz.Tokenizer("bpe", {t: i + 3 for i, t in enumerate(dict.fromkeys(symbols))}, merges=pairs, byte_level=True)


@register("encode_bpe", "SELECT doc_id, text FROM documents")
def _encode_bpe(spark, sf):
    """Byte-level merges trained on the corpus, whole texts to ids and back."""
    tok = bpe_tokenizer(spark, sf)
    return tk.decode(tk.encode(byte_pieces(spark, sf), "pieces", tok), "input_ids", tok).select("doc_id", "text")


def unigram_vocab(pieces):
    from retort.operators import vocab_train as vt
    words = tk.token_counts(pieces).withColumnRenamed("token", "word")
    return vt.train_unigram(words, vocab_size=VOCAB_SIZE, min_freq=20, sub_rounds=1, shrink=0.4)


def unigram_tokenizer(pieces):
    rows = [r for r in unigram_vocab(pieces).collect() if r["id"] >= len(tk.SPECIALS)]
    return tz.Tokenizer("unigram", {r["token"]: int(r["id"]) for r in rows}, scores={r["token"]: r["score"] for r in rows})


@register("encode_unigram", W(SQL_PIECES) + """
 SELECT doc_id, ltrim(replace(array_to_string(pieces, ''), '▁', ' ')) AS text, len(array_to_string(pieces, '')) AS n_chars FROM fx_pieces""")
def _encode_unigram(spark, sf):
    """Best paths over the trained vocabulary, which holds every character: the tokens of a text join to the text."""
    pieces = pieces_df(spark, sf)
    tok = unigram_tokenizer(pieces)
    text = F.ltrim(F.col("text"))
    out = tk.decode(tk.encode(pieces, "pieces", tok), "input_ids", tok).select(
        "doc_id", text.alias("text"), F.length(F.array_join("pieces", "")).cast("long").alias("n_chars"))
    return out


# Tokens of the best-path query: the vocabulary's words and every character, with whole-number scores that both engines share.
SQL_PATHS = SQL_VOCAB + """,
ps AS (SELECT row_number() OVER () AS k, p FROM (SELECT DISTINCT unnest(pieces) AS p FROM fx_pieces)),
ch AS (SELECT DISTINCT unnest(string_split(p, '')) AS token FROM ps),
tokens AS (SELECT token, id, -CAST(1000 + id AS DOUBLE) AS score FROM fx_vocab WHERE id > 2
           UNION ALL SELECT token, -1, CAST(-3000 AS DOUBLE) FROM ch WHERE token NOT IN (SELECT token FROM fx_vocab)),
longest AS (SELECT max(length(token)) AS n FROM tokens),
edges AS (SELECT k, e, list({'s': s, 'score': score, 'id': CASE WHEN id < 0 THEN 2 ELSE id END} ORDER BY s) AS opts
          FROM (SELECT k, s, s + d AS e, substr(p, s + 1, d) AS token
                FROM (SELECT k, p, s, unnest(range(1, least(length(p) - s, (SELECT n FROM longest)) + 1)) AS d
                      FROM (SELECT k, p, unnest(range(0, length(p))) AS s FROM ps))) JOIN tokens USING (token) GROUP BY k, e),
dp AS (SELECT k, 0 AS t, [CAST(0 AS DOUBLE)] AS best, [CAST([] AS BIGINT[])] AS ids FROM ps
       UNION ALL
       SELECT k, t + 1, list_append(best, top), list_append(ids, list_append(ids[o.s + 1], o.id))
       FROM (SELECT k, t, best, ids, top, list_filter(opts, lambda x: best[x.s + 1] + x.score = top)[1] AS o
             FROM (SELECT dp.k, t, best, ids, opts, list_max(list_transform(opts, lambda x: best[x.s + 1] + x.score)) AS top
                   FROM dp JOIN edges ON edges.k = dp.k AND edges.e = dp.t + 1))),
paths AS (SELECT p, ids[t + 1] AS ids FROM dp JOIN ps USING (k) WHERE t = length(p))"""


@register("encode_paths", W(SQL_PATHS).replace("WITH ", "WITH RECURSIVE ", 1) + """
 SELECT doc_id, CAST(list_append(coalesce(flatten(list(ids ORDER BY i)), []), 1) AS INTEGER[]) AS input_ids
 FROM (SELECT doc_id, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS p FROM fx_pieces) JOIN paths USING (p) GROUP BY doc_id""")
def _encode_paths(spark, sf):
    """Ids of the best paths over words and characters; of equal paths the one with the longest last token."""
    pieces = pieces_df(spark, sf)
    rows = [r for r in vocab_df(spark, sf).collect() if r["id"] > 2]
    scores = {r["token"]: -float(1000 + r["id"]) for r in rows}
    chars = pieces.select(F.explode("pieces").alias("p")).select(F.explode(F.split("p", "")).alias("c")).distinct()
    for r in chars.limit(tz.MAX_VOCAB).collect():
        scores.setdefault(r["c"], -3000.0)
    tok = tz.Tokenizer("unigram", {r["token"]: int(r["id"]) for r in rows}, scores=scores)
    return tk.encode(pieces, "pieces", tok).select("doc_id", "input_ids")


N_PAIRS = 200
SQL_MERGES = SQL_PIECES + f""",
cs AS (SELECT p, n, string_split(p, '') AS c FROM (SELECT p, count(*) AS n FROM (SELECT unnest(pieces) AS p FROM fx_pieces) GROUP BY p)),
pairs AS (SELECT a, b, row_number() OVER (ORDER BY n DESC, a, b) - 1 AS rank
          FROM (SELECT c[i] AS a, c[i + 1] AS b, sum(n) AS n FROM (SELECT c, n, unnest(range(1, len(c))) AS i FROM cs) GROUP BY 1, 2)
          ORDER BY rank LIMIT {N_PAIRS}),
steps AS (SELECT list([chr(1) || a || chr(2) || chr(1) || b || chr(2), chr(1) || a || b || chr(2)] ORDER BY rank) AS m FROM pairs),
ids AS (SELECT token, row_number() OVER (ORDER BY kind, rank, token) + 2 AS id
        FROM (SELECT a || b AS token, 0 AS kind, min(rank) AS rank FROM pairs GROUP BY 1
              UNION ALL SELECT DISTINCT unnest(c), 1, 0 FROM cs)),
marked AS (SELECT p, list_reduce(m, lambda w, z: [replace(w[1], z[1], z[2])], [chr(1) || array_to_string(c, chr(2) || chr(1)) || chr(2)])[1] AS w
           FROM cs, steps),
toks AS (SELECT p, list(id ORDER BY i) AS ids
         FROM (SELECT p, generate_subscripts(t, 1) AS i, unnest(t) AS token
               FROM (SELECT p, string_split(w[2:-2], chr(2) || chr(1)) AS t FROM marked)) JOIN ids USING (token) GROUP BY p)"""


def frequent_pairs(pieces):
    """The N_PAIRS most frequent neighbours (a, b) among the characters of the pieces, most frequent first."""
    counts = tk.token_counts(pieces).select("n", F.split("token", "").alias("c"))
    couples = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))
    return (counts.where(F.size("c") > 1).select("n", F.inline(couples)).groupBy("a", "b").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "a", "b").limit(N_PAIRS))


@register("encode_merges", W(SQL_MERGES) + """
 SELECT doc_id, CAST(list_append(coalesce(flatten(list(ids ORDER BY i)), []), 1) AS INTEGER[]) AS input_ids
 FROM (SELECT doc_id, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS p FROM fx_pieces) JOIN toks USING (p) GROUP BY doc_id""")
def _encode_merges(spark, sf):
    """Ids after the merges of the most frequent pairs of characters, made in the order of their ranks."""
    pieces = pieces_df(spark, sf)
    counts = tk.token_counts(pieces).select("n", F.split("token", "").alias("c"))
    pairs = frequent_pairs(pieces).collect()
    chars = counts.select(F.explode("c").alias("c")).distinct().limit(tz.MAX_VOCAB).collect()
    symbols = list(dict.fromkeys(r["a"] + r["b"] for r in pairs)) + sorted(r["c"] for r in chars)
    tok = tz.Tokenizer("bpe", {t: i + 3 for i, t in enumerate(symbols)}, merges=[(r["a"], r["b"]) for r in pairs])
    return tk.encode(pieces, "pieces", tok).select("doc_id", "input_ids")


@register("oov_rows", W(SQL_VOCAB) + """
 , o AS (SELECT doc_id, list_sort(list_distinct(list_filter(pieces, lambda p: m[p] IS NULL))) AS oov FROM fx_pieces, fx_vmap)
 SELECT doc_id, oov FROM o WHERE len(oov) > 0""")
def _oov(spark, sf):
    return tk.oov_rows(pieces_df(spark, sf), "pieces", vocab_df(spark, sf)).select("doc_id", "oov")


@register("add_tokens", W(SQL_VOCAB) + f"""
 , nb AS (SELECT DISTINCT unnest(regexp_extract_all(CASE WHEN starts_with(m, '▁') THEN m ELSE '▁' || m END, '{tk.PIECE_PATTERN}')) AS token
          FROM (SELECT {_NORM} AS m FROM benchmark))
 , fresh AS (SELECT token FROM nb WHERE token NOT IN (SELECT token FROM fx_vocab))
 SELECT token, CAST(id AS BIGINT) AS id FROM fx_vocab
 UNION ALL SELECT token, (SELECT max(id) FROM fx_vocab) + row_number() OVER (ORDER BY token) FROM fresh""")
def _add_tokens(spark, sf):
    bench = td.table(spark, sf, "benchmark").select("text")
    new = tk.pretokenise(bench, "text").select(F.explode("pieces").alias("token"))
    return tk.add_tokens(vocab_df(spark, sf), new)


@register("pad_truncate", W(SQL_VOCAB) + """
 SELECT doc_id,
   CASE WHEN len(input_ids) > 128 THEN list_append(list_slice(input_ids, 1, 127), 1)
        ELSE list_concat(input_ids, repeat([0], 128 - len(input_ids))) END AS input_ids,
   list_concat(repeat([1], least(len(input_ids), 128)), repeat([0], 128 - least(len(input_ids), 128))) AS attention_mask
 FROM fx_enc""")
def _pad_truncate(spark, sf):
    return tk.pad_truncate(encoded(spark, sf), "input_ids", 128).select("doc_id", "input_ids", "attention_mask")


@register("collate_labels", W(SQL_VOCAB) + """
 , w AS (SELECT doc_id, input_ids, greatest(128, (len(input_ids) + 127) // 128 * 128) AS width FROM fx_enc)
 SELECT doc_id, list_transform(list_concat(input_ids, repeat([0], width - len(input_ids))),
        lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS labels
 FROM w""")
def _collate(spark, sf):
    x = tk.pad_to_multiple(encoded(spark, sf), "input_ids", 128)
    return x.select("doc_id", tk.collate_labels("input_ids").alias("labels"))


SQL_LINES = """
fx_lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents)"""


def lines_df(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@register("drop_blank_lines", W(SQL_LINES) + " SELECT doc_id, line_no, line FROM fx_lines WHERE length(regexp_replace(line, '\\s', '', 'g')) > 0")
def _drop_blank(spark, sf):
    return drop_blank_lines(lines_df(spark, sf), "line")


@register("line_by_line_encode", W(SQL_VOCAB, SQL_LINES) + f"""
 , lp AS (SELECT doc_id, line_no, regexp_extract_all(CASE WHEN starts_with(m, '▁') THEN m ELSE '▁' || m END, '{tk.PIECE_PATTERN}') AS pieces
          FROM (SELECT doc_id, line_no, {_NORM.replace('(text,', '(line,')} AS m FROM fx_lines
                WHERE length(regexp_replace(line, '\\s', '', 'g')) > 0))
 , le AS (SELECT doc_id, line_no, list_append(list_transform(pieces, lambda p: CAST(coalesce(m[p], 2) AS INTEGER)), 1) AS ids FROM lp, fx_vmap)
 SELECT doc_id, line_no, CASE WHEN len(ids) > 64 THEN list_append(list_slice(ids, 1, 63), 1)
        ELSE list_concat(ids, repeat([0], 64 - len(ids))) END AS input_ids FROM le""")
def _line_by_line(spark, sf):
    lines = drop_blank_lines(lines_df(spark, sf), "line")
    p = tk.pretokenise(lines, "line")
    e = tk.encode(p, "pieces", vocab_df(spark, sf), out="ids")
    return tk.pad_truncate(e, "ids", 64).select("doc_id", "line_no", "input_ids")


SQL_PACK = f"""
fx_pk AS (
  SELECT doc_id, input_ids, grp, len(input_ids) AS l,
         coalesce(sum(len(input_ids)) OVER (PARTITION BY grp ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         sum(len(input_ids)) OVER (PARTITION BY grp) AS tot
  FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS grp, row_number() OVER (ORDER BY doc_id) AS rn FROM fx_enc)),
fx_pk_tok AS (
  SELECT grp, off + generate_subscripts(input_ids, 1) - 1 AS g, unnest(input_ids) AS id,
         CASE WHEN tot >= {PACK_LEN} THEN tot // {PACK_LEN} * {PACK_LEN} ELSE tot END AS keep FROM fx_pk),
fx_packed AS (
  SELECT grp AS "group", g // {PACK_LEN} AS chunk, list(id ORDER BY g) AS input_ids FROM fx_pk_tok WHERE g < keep GROUP BY 1, 2)"""


def packed(spark, sf):
    return tk.pack_chunks(encoded(spark, sf), "input_ids", ["doc_id"], PACK_LEN, group_rows=1000)


@register("pack_chunks", W(SQL_VOCAB, SQL_PACK) + ' SELECT "group", chunk, input_ids FROM fx_packed')
def _pack(spark, sf):
    return packed(spark, sf)


def _sql_seg(items, m, kind):
    """Cuts drawn one by one: 1 + hash mod j, or j where that one is taken; then 0, the sorted cuts and the end."""
    j = "step[1]"
    t = f"CAST(CAST(('0x' || substr(md5(k || '|{kind}|' || CAST({j} AS VARCHAR)), 1, 8)) AS BIGINT) % {j} + 1 AS INTEGER)"
    draws = (f"list_reduce(list_transform(range(greatest({items} - {m} + 1, 1), {items}), lambda z: [CAST(z AS INTEGER)]), "
             f"lambda taken, step: list_append(taken, CASE WHEN list_contains(taken, {t}) THEN {j} ELSE {t} END), CAST([] AS INTEGER[]))")
    return f"list_concat([0], list_concat(list_sort({draws}), [{items}]))"


SQL_MASK = f"""
fx_mp AS (
  SELECT "group", chunk, input_ids, n, k, noise, spans, n - noise AS keep FROM (
    SELECT *, CAST(greatest(round_even(noise / CAST(3.0 AS DOUBLE), 0), 1) AS INTEGER) AS spans FROM (
      SELECT *, CAST(least(greatest(round_even(n * CAST(0.15 AS DOUBLE), 0), 1), n - 1) AS INTEGER) AS noise FROM (
        SELECT "group", chunk, input_ids, len(input_ids) AS n, CAST("group" AS VARCHAR) || '|' || CAST(chunk AS VARCHAR) AS k
        FROM fx_packed)))),
fx_mb AS (SELECT "group", chunk, input_ids, spans, {_sql_seg('noise', 'spans', 'noise')} AS nb,
                 {_sql_seg('keep', 'spans', 'nonnoise')} AS kb FROM fx_mp),
fx_mask AS (
  SELECT "group", chunk, input_ids, flatten(list_transform(range(1, spans + 1), lambda i:
      list_concat(repeat([false], kb[i + 1] - kb[i]), repeat([true], nb[i + 1] - nb[i])))) AS mask FROM fx_mb)"""


def masked(spark, sf):
    p = packed(spark, sf)
    key = F.concat_ws("|", F.col("group").cast("string"), F.col("chunk").cast("string"))
    return p.withColumn("mask", tk.span_mask(F.size("input_ids"), key))


@register("span_mask", W(SQL_VOCAB, SQL_PACK, SQL_MASK) + ' SELECT "group", chunk, mask FROM fx_mask')
def _span_mask(spark, sf):
    return masked(spark, sf).select("group", "chunk", "mask")


def _sql_sentinel(mask):
    starts = f"list_transform({mask}, lambda x, i: x AND (i = 1 OR NOT {mask}[i - 1]))"
    return (f"list_transform({mask}, lambda x, i: CASE WHEN x AND (i = 1 OR NOT {mask}[i - 1]) "
            f"THEN {FULL_SIZE} - len(list_filter(list_slice({starts}, 1, i), lambda y: y)) "
            f"WHEN x THEN -1 ELSE 0 END)")


SQL_SENT = f""",
fx_sent AS (SELECT "group", chunk, input_ids, mask, {_sql_sentinel('mask')} AS s_in,
             {_sql_sentinel('list_transform(mask, lambda z: NOT z)')} AS s_lab FROM fx_mask),
fx_fused AS (
  SELECT "group", chunk,
    list_append(list_filter(list_transform(list_zip(input_ids, s_in), lambda e: CASE WHEN e[2] <> 0 THEN e[2] ELSE e[1] END), lambda v: v >= 0), 1) AS input_ids,
    list_append(list_filter(list_transform(list_zip(input_ids, s_lab), lambda e: CASE WHEN e[2] <> 0 THEN e[2] ELSE e[1] END), lambda v: v >= 0), 1) AS labels
  FROM fx_sent)"""


def sentinels(spark, sf):
    m = masked(spark, sf)
    return (m.withColumn("s_in", tk.sentinel_ids("mask", FULL_SIZE))
            .withColumn("s_lab", tk.sentinel_ids(tk.invert_mask("mask"), FULL_SIZE)))


@register("sentinel_ids", W(SQL_VOCAB, SQL_PACK, SQL_MASK) + SQL_SENT + ' SELECT "group", chunk, s_in, s_lab FROM fx_sent')
def _sentinel(spark, sf):
    return sentinels(spark, sf).select("group", "chunk", "s_in", "s_lab")


@register("fuse_spans", W(SQL_VOCAB, SQL_PACK, SQL_MASK) + SQL_SENT + ' SELECT "group", chunk, input_ids, labels FROM fx_fused')
def _fuse(spark, sf):
    s = sentinels(spark, sf)
    return s.select("group", "chunk", tk.fuse_spans("input_ids", "s_in").alias("input_ids"),
                    tk.fuse_spans("input_ids", "s_lab").alias("labels"))


@register("shift_right", W(SQL_VOCAB, SQL_PACK, SQL_MASK) + SQL_SENT + """
 SELECT "group", chunk, list_transform(list_concat([0], list_slice(labels, 1, len(labels) - 1)),
        lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) AS decoder_input_ids FROM fx_fused""")
def _shift(spark, sf):
    f = _fuse(spark, sf)
    return f.select("group", "chunk", tk.shift_right("labels").alias("decoder_input_ids"))


def _u(start):
    return (f"CAST(('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)), {start}, 8)) AS BIGINT)"
            f" / 4294967296.0")


@register("mlm_mask", W(SQL_VOCAB) + f"""
 , t AS (SELECT doc_id, input_ids AS ids FROM fx_enc)
 , p AS (SELECT doc_id, ids, list_transform(ids, lambda x, i: x NOT IN (0, 1, 2) AND {_u(1)} < 0.15) AS picked FROM t)
 SELECT doc_id,
   list_transform(ids, lambda x, i: CASE WHEN NOT picked[i] THEN x WHEN {_u(9)} < 0.8 THEN 1000
        WHEN {_u(9)} < 0.9 THEN CAST(floor({_u(17)} * 1000) AS INTEGER) ELSE x END) AS input_ids,
   list_transform(ids, lambda x, i: CASE WHEN picked[i] THEN x ELSE -100 END) AS labels
 FROM p""")
def _mlm(spark, sf):
    return tk.mlm_rows(encoded(spark, sf), "input_ids", "doc_id", vocab_size=VOCAB_SIZE, mask_id=1000)


# ------------------------------------------------------------------ BLEU

SQL_TOK13A = """
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(
   ' ' || replace(replace(replace(replace(replace(replace(replace(X, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '),
        '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
   '([\\x7b-\\x7e\\x5b-\\x60\\x20-\\x26\\x28-\\x2b\\x3a-\\x40\\x2f])', ' \\1 ', 'g'),
   '([^0-9])([\\.,])', '\\1 \\2 ', 'g'), '([\\.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g')"""


def _sql_tokens(x):
    inner = SQL_TOK13A.replace("X", f"trim({x})")
    return f"list_filter(string_split(trim(regexp_replace({inner}, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


SQL_BLEU = f"""
WITH pairs AS (
  SELECT a.conv_id, a.turn, {_sql_tokens('a.text')} AS h, {_sql_tokens('b.text')} AS r
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
ng AS (SELECT * FROM (VALUES (1), (2), (3), (4)) v(n)),
gh AS (SELECT conv_id, turn, n, gram, count(*) AS ch FROM (
         SELECT conv_id, turn, n, unnest(list_transform(range(0, greatest(len(h) - n + 1, 0)),
                lambda i: array_to_string(list_slice(h, i + 1, i + n), ' '))) AS gram FROM pairs, ng) GROUP BY ALL),
gr AS (SELECT conv_id, turn, n, gram, count(*) AS cr FROM (
         SELECT conv_id, turn, n, unnest(list_transform(range(0, greatest(len(r) - n + 1, 0)),
                lambda i: array_to_string(list_slice(r, i + 1, i + n), ' '))) AS gram FROM pairs, ng) GROUP BY ALL),
m AS (SELECT n, sum(least(ch, cr)) AS c FROM gh JOIN gr USING (conv_id, turn, n, gram) GROUP BY n),
lens AS (SELECT sum(len(h)) AS sys_len, sum(len(r)) AS ref_len,
   sum(greatest(len(h) - 0, 0)) AS total_1, sum(greatest(len(h) - 1, 0)) AS total_2,
   sum(greatest(len(h) - 2, 0)) AS total_3, sum(greatest(len(h) - 3, 0)) AS total_4 FROM pairs),
st AS (SELECT lens.*, coalesce((SELECT c FROM m WHERE n = 1), 0) AS correct_1, coalesce((SELECT c FROM m WHERE n = 2), 0) AS correct_2,
   coalesce((SELECT c FROM m WHERE n = 3), 0) AS correct_3, coalesce((SELECT c FROM m WHERE n = 4), 0) AS correct_4 FROM lens)
SELECT CAST(sys_len AS BIGINT) AS sys_len, CAST(ref_len AS BIGINT) AS ref_len,
  CAST(total_1 AS BIGINT) AS total_1, CAST(total_2 AS BIGINT) AS total_2, CAST(total_3 AS BIGINT) AS total_3, CAST(total_4 AS BIGINT) AS total_4,
  CAST(correct_1 AS BIGINT) AS correct_1, CAST(correct_2 AS BIGINT) AS correct_2, CAST(correct_3 AS BIGINT) AS correct_3, CAST(correct_4 AS BIGINT) AS correct_4,
  CASE WHEN sys_len = 0 OR correct_1 + correct_2 + correct_3 + correct_4 = 0 THEN 0.0 ELSE
   (CASE WHEN sys_len < ref_len THEN exp(1 - ref_len / sys_len) ELSE 1.0 END) *
   exp((ln(100.0 * greatest(correct_1, 1) / total_1 / CASE WHEN correct_1 = 0 THEN 2 ELSE 1 END)
      + ln(100.0 * greatest(correct_2, 1) / total_2 / CASE WHEN correct_2 = 0 THEN pow(2, z2) ELSE 1 END)
      + ln(100.0 * greatest(correct_3, 1) / total_3 / CASE WHEN correct_3 = 0 THEN pow(2, z3) ELSE 1 END)
      + ln(100.0 * greatest(correct_4, 1) / total_4 / CASE WHEN correct_4 = 0 THEN pow(2, z4) ELSE 1 END)) / 4) END AS bleu
FROM (SELECT *, z1 + CAST(correct_2 = 0 AS INT) AS z2, z1 + CAST(correct_2 = 0 AS INT) + CAST(correct_3 = 0 AS INT) AS z3,
        z1 + CAST(correct_2 = 0 AS INT) + CAST(correct_3 = 0 AS INT) + CAST(correct_4 = 0 AS INT) AS z4
      FROM (SELECT *, CAST(correct_1 = 0 AS INT) AS z1 FROM st))"""


@register("corpus_bleu", SQL_BLEU)
def _bleu(spark, sf):
    c = td.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    pairs = c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("hyp"), "ref")
    out = bl.corpus_bleu(pairs, ["conv_id", "turn"], "hyp", "ref")
    return out.select("sys_len", "ref_len", *[f"total_{n}" for n in range(1, 5)],
                      *[f"correct_{n}" for n in range(1, 5)], "bleu")


# ------------------------------------------------------------------ vocabulary training (property checks)

@register("train_bpe")
def _train_bpe(spark, sf):
    from retort.operators import vocab_train as vt
    docs = td.table(spark, sf, "documents").select("text")
    merges, _ = vt.train_bpe(vt.byte_level_words(docs, "text"), num_merges=BPE_MERGES)
    return merges


@register("train_unigram")
def _train_unigram(spark, sf):
    return unigram_vocab(pieces_df(spark, sf))


@register("span_lengths", """
 WITH l AS (SELECT doc_id, length(text) AS inputs_length FROM documents),
 d AS (SELECT inputs_length, unnest(range(inputs_length, CAST(inputs_length * 1.2 AS BIGINT) + 20)) AS n
       FROM (SELECT DISTINCT inputs_length FROM l WHERE inputs_length IS NOT NULL)),
 s AS (SELECT inputs_length, n, round_even(n * 0.15::DOUBLE, 0) AS noise FROM d),
 p AS (SELECT *, round_even(noise / 3.0::DOUBLE, 0) AS spans FROM s),
 b AS (SELECT inputs_length, max(n) AS raw_length, CAST(arg_max(noise + spans, n) + 1 AS BIGINT) AS target_length
       FROM p WHERE n - noise + spans + 1 <= inputs_length GROUP BY 1)
 SELECT doc_id, inputs_length, raw_length, target_length FROM l LEFT JOIN b USING (inputs_length)""")
def _span_lengths(spark, sf):
    """Raw and target lengths for masked inputs as long as each document."""
    docs = td.table(spark, sf, "documents").select("doc_id", F.length("text").alias("inputs_length"))
    return tk.span_lengths_of(docs, "inputs_length")
