"""Queries over n-grams, vocabulary, TF-IDF retrieval, context blocks and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as FI
from ..operators import prompts as P
from ..operators import retrieve as R
from ..operators import vocab as V
from ..operators.summary import list_sorted
from .common import table
from .sqlparts import q, strip_ws_sql, tfidf_ctes, topk_ctes

QUERIES = {}
SQL = {}

MAX_TERMS = 5000
TOP_K = 3
PAD_MAX_TERMS = 50


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


# --- n-grams, vocabulary, weights -------------------------------------------------------

@register("ngram_counts", f"""
WITH {tfidf_ctes('c_', 'documents', 'doc_id', 'text', MAX_TERMS)}
SELECT k AS doc_id, term, CAST(tf AS BIGINT) AS tf FROM c_tf""")
def ngram_counts(spark, sf):
    d = table(spark, sf, "documents")
    return V.term_counts(d, "doc_id", "text")


@register("vocab_top", f"""
WITH {tfidf_ctes('c_', 'documents', 'doc_id', 'text', MAX_TERMS)}
SELECT term, CAST(total_tf AS BIGINT) AS total_tf, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM c_voc""")
def vocab_top(spark, sf):
    d = table(spark, sf, "documents")
    voc = V.fit_vocabulary(d, "doc_id", "text", MAX_TERMS)
    return voc.df.select("term", "total_tf", "df", _r6(F.col("idf")).alias("idf"))


@register("tfidf_weights", f"""
WITH {tfidf_ctes('c_', 'documents', 'doc_id', 'text', MAX_TERMS, 'benchmark', 'item_id', 'text')}
SELECT 'doc' AS side, k AS id, term, CAST(tf AS BIGINT) AS tf, round(weight, 6) AS weight FROM c_w
UNION ALL
SELECT 'query' AS side, k AS id, term, CAST(tf AS BIGINT) AS tf, round(weight, 6) AS weight FROM c_qw""")
def tfidf_weights(spark, sf):
    d = table(spark, sf, "documents")
    b = table(spark, sf, "benchmark")
    voc = V.fit_vocabulary(d, "doc_id", "text", MAX_TERMS)
    dw = V.postings(V.tfidf(d, "doc_id", "text", voc), "doc_id")
    qw = V.postings(V.tfidf(b, "item_id", "text", voc), "item_id")
    return (dw.select(F.lit("doc").alias("side"), F.col("doc_id").alias("id"), "term", "tf",
                      _r6(F.col("weight")).alias("weight"))
            .unionByName(qw.select(F.lit("query").alias("side"), F.col("item_id").alias("id"), "term", "tf",
                                   _r6(F.col("weight")).alias("weight"))))


# --- retrieval ---------------------------------------------------------------------------

def _doc_hits(spark, sf, k=TOP_K):
    d = table(spark, sf, "documents")
    b = table(spark, sf, "benchmark")
    index = R.build_index(d, "doc_id", "text", MAX_TERMS)
    return d, b, R.retrieve(b, "item_id", "text", index, k)


_HITS = (tfidf_ctes('c_', 'documents', 'doc_id', 'text', MAX_TERMS, 'benchmark', 'item_id', 'text')
         + ",\n" + topk_ctes('c_', 'documents', 'doc_id', 'benchmark', 'item_id', TOP_K))


@register("retrieve_topk", f"""
WITH {_HITS}
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, round(sim, 6) AS sim FROM c_hits""")
def retrieve_topk(spark, sf):
    _, _, hits = _doc_hits(spark, sf)
    return hits.select("query_id", F.col("rank").cast("long"), "doc_id", _r6(F.col("sim")).alias("sim"))


@register("retrieve_topk_pad", f"""
WITH {tfidf_ctes('p_', 'benchmark', 'item_id', 'text', PAD_MAX_TERMS, 'documents', 'doc_id', 'text')},
{topk_ctes('p_', 'benchmark', 'item_id', 'documents', 'doc_id', TOP_K)}
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id AS item_id, round(sim, 6) AS sim FROM p_hits""")
def retrieve_topk_pad(spark, sf):
    """Corpus = benchmark with a 50-term vocabulary, queries = every document: most
    non-English documents share no term with it, so their lists are zero-score padding."""
    b = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents")
    index = R.build_index(b, "item_id", "text", PAD_MAX_TERMS)
    hits = R.retrieve(d, "doc_id", "text", index, TOP_K)
    return hits.select("query_id", F.col("rank").cast("long"), F.col("doc_id").alias("item_id"),
                       _r6(F.col("sim")).alias("sim"))


def _context_sql(hits: str, docs: str, key: str, name_expr: str, text: str) -> str:
    """(query_id, sources, context) from hits joined to the corpus, in rank order."""
    return f"""(SELECT h.query_id,
        CAST(to_json(list({name_expr} ORDER BY h.rank)) AS VARCHAR) AS sources,
        string_agg('[' || {name_expr} || ']' || chr(10) || substring({text}, 1, 800), chr(10) || chr(10)
                   ORDER BY h.rank) AS context
 FROM {hits} h JOIN {docs} dd ON dd.{key} = h.doc_id GROUP BY h.query_id)"""


@register("context_block", f"""
WITH {_HITS}
SELECT * FROM {_context_sql('c_hits', 'documents', 'doc_id', 'CAST(dd.doc_id AS VARCHAR)', 'dd.text')}""")
def context_block(spark, sf):
    d, _, hits = _doc_hits(spark, sf)
    ctx = P.context_block(hits, d, "doc_id", "text")
    return ctx.select("query_id", F.to_json("sources").alias("sources"), "context")


# --- web results and prompts -------------------------------------------------------------

def _page_title_sql(h):
    return f"regexp_extract({h}, {q(r'(?is)<title[^>]*>(.*?)</title>')}, 1)"


def _page_text_sql(h):
    body = f"regexp_extract({h}, {q(r'(?is)<article[^>]*>(.*?)</article>')}, 1)"
    no_tags = f"regexp_replace({body}, '<[^>]*>', ' ', 'g')"
    return strip_ws_sql(f"regexp_replace({no_tags}, {q('[' + T.WS_CLASS + ']+')}, ' ', 'g')")


def _web_rows(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", P.page_title("html").alias("title"), P.page_text("html").alias("content"))


_HOST_RE = r"^[a-z]+://([^/]+)/"


def _web_fold_sql(results: str, group: str, order: str) -> str:
    """F5 fold in SQL over ``results(group, order, title, content)``."""
    return f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rk
            FROM {results} res),
 r2 AS (SELECT {group} AS g, rk, coalesce(nullif(title, ''), 'Untitled Source') AS t,
               {strip_ws_sql("coalesce(content, '')")} AS c FROM r WHERE rk <= {TOP_K})
 SELECT g AS {group}, CAST(to_json(list('web: ' || t ORDER BY rk)) AS VARCHAR) AS sources,
        string_agg('[' || t || ']' || chr(10) || substring(c, 1, 800), chr(10) || chr(10) ORDER BY rk) AS context
 FROM r2 WHERE c <> '' GROUP BY g)"""


@register("web_results", f"""
SELECT * FROM {_web_fold_sql(f"(SELECT regexp_extract(url, {q(_HOST_RE)}, 1) AS host, page_id, "
                             f"{_page_title_sql('html')} AS title, {_page_text_sql('html')} AS content FROM pages)",
                             'host', 'page_id')}""")
def web_results(spark, sf):
    """F5 over pages as search results: results of a host (from the URL) in page
    order, first 3 kept, empty bodies dropped."""
    r = _web_rows(spark, sf).withColumn("host", F.regexp_extract("url", _HOST_RE, 1))
    out = P.normalise_results(r, "host", "page_id", TOP_K)
    return out.select("host", F.to_json("sources").alias("sources"), "context")


_FLAGS = [(True, True), (True, False), (False, True), (False, False)]


def _prompts_sql() -> str:
    nl2 = "chr(10) || chr(10)"
    page_corpus = f"(SELECT page_id, {_page_text_sql('html')} AS content FROM pages)"
    parts = [tfidf_ctes('c_', 'documents', 'doc_id', 'text', MAX_TERMS, 'benchmark', 'item_id', 'text'),
             topk_ctes('c_', 'documents', 'doc_id', 'benchmark', 'item_id', TOP_K),
             f"pg AS {page_corpus}",
             tfidf_ctes('w_', 'pg', 'page_id', 'content', MAX_TERMS, 'benchmark', 'item_id', 'text'),
             topk_ctes('w_', 'pg', 'page_id', 'benchmark', 'item_id', TOP_K),
             f"dctx AS {_context_sql('c_hits', 'documents', 'doc_id', 'CAST(dd.doc_id AS VARCHAR)', 'dd.text')}",
             f"wres AS (SELECT h.query_id, h.rank, {_page_title_sql('p.html')} AS title, "
             f"{_page_text_sql('p.html')} AS content FROM w_hits h JOIN pages p ON p.page_id = h.doc_id)",
             f"wctx AS {_web_fold_sql('wres', 'query_id', 'rank')}",
             "flags AS (SELECT * FROM (VALUES (TRUE, TRUE), (TRUE, FALSE), (FALSE, TRUE), (FALSE, FALSE)) "
             "AS f(use_rag, use_web))",
             f"""base AS (SELECT b.item_id AS query_id, b.text AS query, f.use_rag, f.use_web,
        CASE WHEN f.use_rag THEN coalesce(d.context, '') ELSE '' END AS dc,
        CASE WHEN f.use_web THEN coalesce(w.context, '') ELSE '' END AS wc,
        CASE WHEN f.use_rag THEN coalesce(CAST(d.sources AS JSON)::VARCHAR[], []) ELSE [] END AS ds,
        CASE WHEN f.use_web THEN coalesce(CAST(w.sources AS JSON)::VARCHAR[], []) ELSE [] END AS ws
 FROM benchmark b CROSS JOIN flags f LEFT JOIN dctx d ON d.query_id = b.item_id
      LEFT JOIN wctx w ON w.query_id = b.item_id)""",
             f"""ctx AS (SELECT *, CASE WHEN wc <> '' THEN {strip_ws_sql(f"dc || {nl2} || wc")} ELSE dc END AS c FROM base)"""]
    return "WITH " + ",\n".join(parts) + f"""
SELECT query_id, use_rag, use_web, {q(P.SYSTEM_PROMPT)} AS system_prompt,
       CASE WHEN use_rag AND c <> '' THEN {q(P.RAG_INSTRUCTION)} || {nl2} || 'Context:' || chr(10) || c
            || {nl2} || 'Question: ' || query ELSE query END AS prompt,
       CAST(to_json(list_concat(ds, ws)) AS VARCHAR) AS sources
FROM ctx"""


@register("prompts", _prompts_sql())
def prompts(spark, sf):
    """F6-F8 for every benchmark question under the four rag/web settings; web results are
    the 3 pages most similar to the question."""
    d, b, hits = _doc_hits(spark, sf)
    doc_ctx = P.context_block(hits, d, "doc_id", "text")
    pages = _web_rows(spark, sf)
    pindex = R.build_index(pages, "page_id", "content", MAX_TERMS)
    whits = R.retrieve(b, "item_id", "text", pindex, TOP_K)
    # hits are k per question; the planner broadcasts them when its size estimate allows
    wres = pages.select(F.col("page_id").alias("doc_id"), "title", "content").join(whits, "doc_id")
    web_ctx = P.normalise_results(wres, "query_id", "rank", TOP_K)
    # contexts are joined once per question; the four settings are a generator over a
    # literal array (no union of four plans, no cross join)
    base = P.with_contexts(b, "item_id", "text", doc_ctx, web_ctx)
    flags = F.array(*[F.struct(F.lit(r).alias("use_rag"), F.lit(w).alias("use_web")) for r, w in _FLAGS])
    rows = base.select("*", F.inline(flags))
    cols = P.prompt_columns(F.col("query"), F.col("__ds"), F.col("__dc"), F.col("__ws"), F.col("__wc"),
                            F.col("use_rag"), F.col("use_web"))
    return rows.select("query_id", "use_rag", "use_web", *cols).select(
        "query_id", "use_rag", "use_web", "system_prompt", "prompt", F.to_json("sources").alias("sources"))


@register("prompts_simple", f"""
SELECT item_id AS query_id, {q(P.SYSTEM_PROMPT_V1 + chr(10) + chr(10) + 'User: ')} || text AS prompt FROM benchmark""")
def prompts_simple(spark, sf):
    return P.simple_prompt(table(spark, sf, "benchmark"), "item_id", "text")


@register("kb_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS n_docs, count(*) = 0 AS is_empty
FROM documents WHERE {strip_ws_sql('text')} <> ''""")
def kb_stats(spark, sf):
    """F10 over the knowledge base as A4 loads it: blank documents do not count."""
    return P.corpus_stats(FI.drop_blank(table(spark, sf, "documents", spread_rows=False), "text"))


@register("kb_listing", f"""
SELECT CAST(doc_id AS VARCHAR) AS name FROM documents WHERE {strip_ws_sql('text')} <> '' ORDER BY name""")
def kb_listing(spark, sf):
    """H8: the names of the knowledge base's documents, sorted."""
    d = FI.drop_blank(table(spark, sf, "documents", spread_rows=False), "text")
    return list_sorted(d.select(F.col("doc_id").cast("string").alias("name")), "name")
