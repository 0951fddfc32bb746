"""Queries over cleaning, tokenising, lexicon scoring and summaries (B, C, D, H ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as L
from ..operators import lexicon_carry as LC
from ..operators import summary as H
from .common import table
from .fixtures import lexicon_df
from .sqlparts import (carried_polarity_sql, clean_text_sql, display_label_sql, drop_stop_sql, index_tokens_sql,
                       lexicon_polarity_sql, normalise_sql, q, round3_avg_sql, sign_label_sql,
                       strip_ws_sql, ws_tokens_sql)

QUERIES = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --- cleaning ----------------------------------------------------------------------------

@register("clean_text", f"SELECT doc_id, {clean_text_sql('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.clean_text("text").alias("cleaned"))


@register("strip_urls_pages", f"""
SELECT page_id, {normalise_sql('url')} AS url_clean,
       regexp_replace(url || ' ' || html, {q(T.URL_PATTERN)}, '', 'g') AS page_clean
FROM pages""")
def strip_urls_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.normalise("url").alias("url_clean"),
                    T.strip_urls(F.concat_ws(" ", "url", "html")).alias("page_clean"))


@register("index_tokens", f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {index_tokens_sql('text')} AS toks FROM documents)""")
def index_tokens(spark, sf):
    d = table(spark, sf, "documents")
    toks = T.index_tokens("text")
    return d.select("doc_id", toks.alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("tokens_no_stop", f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(kept) AS BIGINT) AS n_kept,
       array_to_string(kept, ' ') AS kept
FROM (SELECT doc_id, toks, {drop_stop_sql('toks')} AS kept
      FROM (SELECT doc_id, {ws_tokens_sql(normalise_sql('text'))} AS toks FROM documents))""")
def tokens_no_stop(spark, sf):
    d = table(spark, sf, "documents")
    toks = T.normalised_tokens("text")
    return (d.select("doc_id", toks.alias("toks"))
            .select("doc_id", "toks", T.drop_stop_words("toks").alias("kept"))
            .select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                    F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", " ").alias("kept")))


@register("prefix_cut", """
SELECT doc_id, substring(text, 1, 512) AS p512, substring(text, 1, 800) AS p800,
       CAST(length(substring(text, 1, 800)) AS BIGINT) AS len800
FROM documents""")
def prefix_cut(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.prefix("text", 512).alias("p512"), T.prefix("text", 800).alias("p800"),
                    F.length(T.prefix("text", 800)).cast("long").alias("len800"))


@register("text_present", "SELECT doc_id, quality FROM labels LEFT JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL")
def text_present(spark, sf):
    """B1: labelled rows without a text (no such document, or a null one) are dropped."""
    from ..operators.filters import drop_null_text
    lab = table(spark, sf, "labels", spread_rows=False).select("doc_id", "quality")
    d = table(spark, sf, "documents", spread_rows=False).select("doc_id", "text")
    return drop_null_text(lab.join(d, "doc_id", "left"), "text").select("doc_id", "quality")


@register("drop_empty_clean", f"""
SELECT CAST(count(*) AS BIGINT) AS n_loaded,
       CAST(count(d.text) AS BIGINT) AS n_text,
       CAST(sum(CASE WHEN length({strip_ws_sql('coalesce(d.text, \'\')')}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_non_blank,
       CAST(sum(CASE WHEN {strip_ws_sql(clean_text_sql('d.text'))} <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_clean,
       CAST(sum(CASE WHEN {strip_ws_sql(clean_text_sql('d.text'))} <> '' AND l.quality IS NOT NULL
                THEN 1 ELSE 0 END) AS BIGINT) AS n_clean_labelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def drop_empty_clean(spark, sf):
    from ..operators.filters import drop_empty_clean as drop_empty
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels", spread_rows=False)
    # labels is keyed by doc_id; the join is a plain equi-join (AQE picks broadcast at runtime
    # when the labelled side is small).
    j = d.join(lab, "doc_id", "left").withColumn("cleaned", T.clean_text("text"))
    kept = drop_empty(j, "cleaned", "quality", flag="kept_flag")
    return kept.agg(
        F.count(F.lit(1)).alias("n_loaded"),
        F.count("text").alias("n_text"),
        F.sum(T.non_blank("text").cast("long")).alias("n_non_blank"),
        F.sum((T.strip_ws("cleaned") != "").cast("long")).alias("n_clean"),
        F.sum(F.col("kept_flag").cast("long")).alias("n_clean_labelled"))


# --- lexicon sentiment -------------------------------------------------------------------

_POL = lexicon_polarity_sql("documents", "doc_id", "text")


@register("lexicon_polarity", f"SELECT doc_id, polarity, n FROM {_POL}")
def lexicon_polarity(spark, sf):
    d = table(spark, sf, "documents")
    return L.lexicon_polarity(d, "doc_id", "text", lexicon_df(spark)).withColumn("n", F.col("n").cast("long"))


@register("lexicon_polarity_carried", f"SELECT doc_id, polarity, n FROM {carried_polarity_sql('documents', 'doc_id', 'text')}")
def lexicon_polarity_carried(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return LC.with_carried_polarity(d, "text", lexicon_df(spark), "polarity", "n").select("doc_id", "polarity", "n")


@register("display_label", f"""
SELECT doc_id, polarity, {sign_label_sql('polarity')} AS sentiment,
       {display_label_sql(sign_label_sql('polarity'))} AS display
FROM {_POL}""")
def display_label(spark, sf):
    d = table(spark, sf, "documents")
    s = L.lexicon_sentiment(d, "doc_id", "text", lexicon_df(spark))
    return s.select("doc_id", "polarity", "sentiment", T.display_label("sentiment").alias("display"))


@register("bulk_scored", f"""
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
       {display_label_sql(sign_label_sql('p.polarity'))} AS "Sentiment", p.polarity AS "Polarity_Score"
FROM documents d JOIN {_POL} p ON d.doc_id = p.doc_id""")
def bulk_scored(spark, sf):
    d = table(spark, sf, "documents")
    return L.bulk_score(d, "text", engine="lexicon", lexicon=lexicon_df(spark))


@register("sentiment_summary", f"""
SELECT coalesce(sentiment, 'ALL') AS sentiment, CAST(count(*) AS BIGINT) AS n_rows,
       coalesce({round3_avg_sql('avg(polarity)')}, 0.0) AS mean_score
FROM (SELECT {sign_label_sql('polarity')} AS sentiment, polarity FROM {_POL})
GROUP BY ROLLUP (sentiment)""")
def sentiment_summary(spark, sf):
    d = table(spark, sf, "documents")
    s = L.lexicon_sentiment(d, "doc_id", "text", lexicon_df(spark))
    return H.sentiment_summary(s, "sentiment", "polarity")
