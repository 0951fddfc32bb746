"""Context blocks, web-result normalisation and prompt assembly (ids F4-F10).

All folds are per query over at most k rows (groups bounded by k), so they are cheap
aggregations; the only join against the corpus is hits -> documents for the snippets. The
hits are stored first, so that retrieval runs once and Spark knows their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# Prompt texts of the app.
SYSTEM_PROMPT = ("You are a factual, neutral political information assistant. "
                 "Answer briefly and factually. If context is provided, use it.")
RAG_INSTRUCTION = ("Use only the context below to answer. If the answer isn't in the context, "
                   "say you don't know.")
SYSTEM_PROMPT_V1 = ("You are a factual, objective, and politically neutral assistant. "
                    "Answer briefly and factually about politics and current events. "
                    "Do not provide opinions or perform sentiment analysis.")
SNIPPET_CHARS = 800
WEB_SOURCE_PREFIX = "web: "


def _fold(df: DataFrame, group: str, order: str, item: Column, sep: str, out: str,
          name: Column | None = None, names_out: str = "sources") -> DataFrame:
    """Per group: items joined by ``sep`` in ``order``; optional ordered list of names."""
    fields = [F.col(order).alias("o"), item.alias("item")]
    if name is not None:
        fields.append(name.alias("name"))
    agg = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__l"))
    cols = [group, F.array_join(F.transform("__l", lambda x: x["item"]), sep).alias(out)]
    if name is not None:
        cols.append(F.transform("__l", lambda x: x["name"]).alias(names_out))
    return agg.select(*cols)


def context_block(hits: DataFrame, docs: DataFrame, key: str, text: str, n: int = SNIPPET_CHARS,
                  name: Column | None = None) -> DataFrame:
    """F4 + F6 (document half): (query_id, sources array<string>, context string).

    ``hits`` = (query_id, rank, doc_id); a source's name is ``name`` (default: the key as text);
    each block is ``"[name]\\n" + first n chars``, blocks joined by a blank line in rank order."""
    nm = name if name is not None else F.col(key).cast("string")
    from ..session import stored
    h = stored(hits.select("query_id", "rank", "doc_id"), "hits")
    d = docs.select(F.col(key).alias("doc_id"), nm.alias("__name"), T.prefix(text, n).alias("__snip"))
    j = d.join(h, "doc_id")
    block = F.concat(F.lit("["), F.col("__name"), F.lit("]\n"), F.col("__snip"))
    return _fold(j, "query_id", "rank", block, "\n\n", "context", F.col("__name"))


def page_title(html) -> Column:
    """Text of the <title> element ('' when there is none)."""
    return F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_text(html) -> Column:
    """Visible article text: tags removed, whitespace runs collapsed, stripped."""
    h = F.col(html) if isinstance(html, str) else html
    body = F.regexp_extract(h, r"(?is)<article[^>]*>(.*?)</article>", 1)
    no_tags = F.regexp_replace(body, r"<[^>]*>", " ")
    return T.strip_ws(F.regexp_replace(no_tags, f"[{T.WS_CLASS}]+", " "))


def normalise_results(results: DataFrame, group: str, order: str, k: int = 3,
                      n: int = SNIPPET_CHARS) -> DataFrame:
    """F5 over a table of search results ``(group, order, title, content)``: the first k
    results per group, empty content dropped, title defaulted; returns
    (group, sources array<'web: title'>, context) with blocks ``"[title]\\n" + content[:n]``."""
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy(order)
    r = (results.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= k)
         .withColumn("__title", T.title_or_default("title"))
         .withColumn("__content", T.strip_ws(F.coalesce(F.col("content"), F.lit(""))))
         .where(F.col("__content") != ""))
    block = F.concat(F.lit("["), F.col("__title"), F.lit("]\n"), T.prefix("__content", n))
    return _fold(r, group, "__rk", block, "\n\n", "context",
                 F.concat(F.lit(WEB_SOURCE_PREFIX), F.col("__title")))


def merge_sources(doc_sources, web_sources) -> Column:
    """document ids then web titles, order and duplicates kept; missing -> empty."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(doc_sources, empty), F.coalesce(web_sources, empty))


def merge_context(doc_ctx, web_ctx) -> Column:
    """only when the web context is non-empty: doc context, blank line, web context, stripped."""
    d = F.coalesce(doc_ctx, F.lit(""))
    w = F.coalesce(web_ctx, F.lit(""))
    return F.when(w != "", T.strip_ws(F.concat(d, F.lit("\n\n"), w))).otherwise(d)


def rag_prompt(query, context, use_rag) -> Column:
    """F8: instruction + context + question when rag is on and there is context, else the query."""
    q, c = F.col(query) if isinstance(query, str) else query, context
    full = F.concat(F.lit(RAG_INSTRUCTION + "\n\nContext:\n"), c, F.lit("\n\nQuestion: "), q)
    return F.when(use_rag & (F.coalesce(c, F.lit("")) != ""), full).otherwise(q)


def prompt_columns(query, doc_sources, doc_ctx, web_sources, web_ctx, use_rag, use_web,
                   web_needs_rag: bool = True) -> list:
    """F6-F8 as columns: [system_prompt, prompt, sources, messages] for one question with its
    document/web contexts and the two settings (Columns or Python bools).

    With ``web_needs_rag`` (the app's behaviour) web context is listed as a source but only
    used in the prompt when rag is on."""
    empty = F.array().cast("array<string>")
    rag = use_rag if isinstance(use_rag, Column) else F.lit(bool(use_rag))
    web = use_web if isinstance(use_web, Column) else F.lit(bool(use_web))
    ds = F.when(rag, F.coalesce(doc_sources, empty)).otherwise(empty)
    dc = F.when(rag, F.coalesce(doc_ctx, F.lit(""))).otherwise(F.lit(""))
    ws = F.when(web, F.coalesce(web_sources, empty)).otherwise(empty)
    wc = F.when(web, F.coalesce(web_ctx, F.lit(""))).otherwise(F.lit(""))
    prompt = rag_prompt(query, merge_context(dc, wc), rag if web_needs_rag else (rag | web))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return [F.lit(SYSTEM_PROMPT).alias("system_prompt"), prompt.alias("prompt"),
            merge_sources(ds, ws).alias("sources"), msgs.alias("messages")]


def with_contexts(queries: DataFrame, qkey: str, qtext: str, doc_ctx: DataFrame | None,
                  web_ctx: DataFrame | None) -> DataFrame:
    """(query_id, query, __ds, __dc, __ws, __wc): each question with its contexts (left joins
    on the question id; contexts hold one row per question)."""
    q = queries.select(F.col(qkey).alias("query_id"), F.col(qtext).alias("query"))
    for ctx, s_col, c_col in ((doc_ctx, "__ds", "__dc"), (web_ctx, "__ws", "__wc")):
        if ctx is None:
            q = q.withColumn(s_col, F.array().cast("array<string>")).withColumn(c_col, F.lit(""))
        else:
            q = q.join(ctx.select("query_id", F.col("sources").alias(s_col), F.col("context").alias(c_col)),
                       "query_id", "left")
    return q


def build_prompts(queries: DataFrame, qkey: str, qtext: str, doc_ctx: DataFrame | None,
                  web_ctx: DataFrame | None, use_rag: bool = True, use_web: bool = False,
                  web_needs_rag: bool = True) -> DataFrame:
    """F6-F8 for a batch of questions: (query_id, system_prompt, prompt, sources, messages)."""
    q = with_contexts(queries, qkey, qtext, doc_ctx if use_rag else None, web_ctx if use_web else None)
    return q.select("query_id", *prompt_columns(F.col("query"), F.col("__ds"), F.col("__dc"), F.col("__ws"),
                                                F.col("__wc"), use_rag, use_web, web_needs_rag))


def simple_prompt(queries: DataFrame, qkey: str, qtext: str) -> DataFrame:
    """F9 (older app): system prompt + blank line + 'User: ' + question."""
    return queries.select(F.col(qkey).alias("query_id"),
                          F.concat(F.lit(SYSTEM_PROMPT_V1 + "\n\nUser: "), F.col(qtext)).alias("prompt"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """number of documents and whether the knowledge base is empty."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).withColumn("is_empty", F.col("n_docs") == 0)
