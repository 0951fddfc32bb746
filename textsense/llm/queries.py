"""The operators' registered queries, each over its whole table with production parameters,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bloom_lm, conv_toxicity, decontaminate, divergence, forest_join, fourier_quality, label_shards, nb_langid,
               pivot_spelling, quality_rules, trie_bpe, warc_chain, wavelet)
from .common import fold, read_table, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


_OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
probe AS (
  SELECT d.doc_id, d.n, d.i, array_to_string(list_slice(d.w, d.i, d.i + d.n - 1), ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, lens WHERE len(w) >= n) d),
hits AS (SELECT p.doc_id, p.n, p.i, v.item_id FROM probe p JOIN wins v ON p.n = v.n AND p.t = v.t),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@register("op1_decontamination", _OP1_SQL)
def op1_decontamination(spark, sf):
    r = decontaminate.report(read_table(spark, sf, "documents"), "doc_id", "text",
                             read_table(spark, sf, "benchmark"), "item_id", "text")
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@register("op2_quality_rules")
def op2_quality_rules(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    rules = quality_rules.Rules()
    measured, m = quality_rules.measure(docs, "text", "lang")
    measured = stored(measured.select("doc_id", *m.values()), "measures")  # counts only: one pass over the texts
    judged, names = quality_rules.verdict(measured, m, quality_rules.references(measured, m, rules), rules)
    return judged.select("doc_id", *[F.col(names[k]).alias(k) for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "common_distance")])


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op5_trie_bpe")
def op5_trie_bpe(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    r = trie_bpe.encode_and_decode(docs, "text", tokenizer_path("byte_bpe_50k.json"))
    return r.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op3_label_shards")
def op3_label_shards(spark, sf):
    r = label_shards.shard(read_table(spark, sf, "documents"), "doc_id", "text")
    return r.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@register("op4_forest_join")
def op4_forest_join(spark, sf):
    r = forest_join.classes(read_table(spark, sf, "documents"), "doc_id", "text")
    return r.select(F.col("id").alias("doc_id"), "class_id", "n_links")


@register("op6_fourier_quality")
def op6_fourier_quality(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    model, stats = fourier_quality.fit(docs, "doc_id", "text", read_table(spark, sf, "labels"), "doc_id", "quality",
                                       learn=fold("id", 3) != 1)
    r = fourier_quality.score(stats, "stats", model, "score")
    return r.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op9_nb_langid")
def op9_nb_langid(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = nb_langid.train(docs.where(fold("doc_id", 5) != 0), "text", "lang")
    r = nb_langid.predict(docs.select("doc_id", "text"), "text", model)
    return r.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@register("op10_bloom_lm")
def op10_bloom_lm(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    model, words = bloom_lm.train(docs.where(fold("doc_id", 7) != 2), "text")
    r = bloom_lm.score(docs, "doc_id", "text", model, words).withColumnRenamed("id", "doc_id")
    return r.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score")


@register("op7_wavelet_files")
def op7_wavelet_files(spark, sf):
    path, files = wavelet.write(read_table(spark, sf, "documents"), "doc_id", "text", tokenizer_path("word_bpe_49k.json"))
    r = wavelet.read(spark, path, files)
    return r.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p),
bits AS (SELECT *, unnest(range(0, 32)) AS k FROM d),
chars AS (
  SELECT page_id, html, last, hex, k,
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           ((((strpos('0123456789abcdef', substr(hex, CAST(5 * k // 4 AS BIGINT) + 1, 1)) - 1) * 16
              + greatest(strpos('0123456789abcdef', substr(hex, CAST(5 * k // 4 AS BIGINT) + 2, 1)) - 1, 0))
             // CAST(pow(2, 3 - (5 * k) % 4) AS BIGINT)) % 32) AS BIGINT), 1) AS c
  FROM bits)
SELECT page_id, CAST(strlen(any_value(html)) AS BIGINT) AS payload_bytes, string_agg(c, '' ORDER BY k) AS payload_digest,
       CASE WHEN page_id < any_value(last) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < any_value(last) THEN any_value(last) END AS refers_to
FROM chars GROUP BY page_id
"""


@register("op8_warc_chain", _OP8_SQL)
def op8_warc_chain(spark, sf):
    r = warc_chain.round_trip(read_table(spark, sf, "pages"), "page_id", "url", "html")
    return r.withColumnRenamed("id", "page_id")


_OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occ o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
gtot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN cnt c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
ltot AS (SELECT lang, sum(n) AS n FROM cnt GROUP BY lang),
gp AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
              CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS HUGEINT) AS p
       FROM gtot g JOIN vocab v ON g.lang = v.lang JOIN kept k ON k.lang = g.lang
       LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lp AS (SELECT c.lang, c.term, CAST(1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // (any_value(l.n) + any_value(v.v)) AS HUGEINT) AS q
       FROM cnt c JOIN ltot l ON c.lang = l.lang JOIN vocab v ON v.lang = c.lang GROUP BY c.lang, c.term),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
              FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT g.lang, g.source, 'term' AS part, g.term AS item, CAST(((g.p - l.q) * (g.p - l.q)) // l.q AS BIGINT) AS value
          FROM gp g JOIN lp l ON g.lang = l.lang AND g.term = l.term WHERE g.n > 0 AND g.p > l.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@register("op11_source_divergence", _OP11_SQL)
def op11_source_divergence(spark, sf):
    return divergence.audit(read_table(spark, sf, "documents"), "text", "lang", "source")


@register("op12_conv_toxicity")
def op12_conv_toxicity(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    model, thresholds = conv_toxicity.fit(docs, "doc_id", "text", read_table(spark, sf, "labels"), "doc_id", "toxic", "lang",
                                          learn=fold("id", 5) != 0)
    scored = conv_toxicity.flag(conv_toxicity.score(docs, "text", model), "score", "lang", thresholds)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


@register("op13_pivot_spelling")
def op13_pivot_spelling(spark, sf):
    return pivot_spelling.variants(read_table(spark, sf, "documents"), "doc_id", "text", every=199)
