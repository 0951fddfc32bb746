"""SQL fragments for the DuckDB oracles, built from the same fixed values as the Spark code."""

from __future__ import annotations

from ..functions import text as T
from ..operators.lexicon_carry import WORD_PATTERN
from .fixtures import lexicon_sql


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def normalise_sql(x: str) -> str:
    """C1-C5 (null -> '')."""
    s = f"coalesce(CAST({x} AS VARCHAR), '')"
    s = f"regexp_replace({s}, {q(T.URL_PATTERN)}, '', 'g')"
    s = f"regexp_replace({s}, {q(T.MENTION_PATTERN)}, '', 'g')"
    s = f"replace({s}, '#', '')"
    s = f"regexp_replace({s}, {q(T.NON_LETTER_PATTERN)}, '', 'g')"
    return f"lower({s})"


def ws_tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.TOKEN_PATTERN)})"


def stop_list_sql() -> str:
    return "[" + ", ".join(q(w) for w in T.STOP_WORDS) + "]"


def drop_stop_sql(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({stop_list_sql()}, t))"


def clean_text_sql(x: str) -> str:
    return f"array_to_string({drop_stop_sql(ws_tokens_sql(normalise_sql(x)))}, ' ')"


def strip_ws_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(T.STRIP_PATTERN)}, '', 'g')"


def index_tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {q(T.INDEX_TOKEN_PATTERN)})"


def round3_avg_sql(x: str) -> str:
    return f"(round({x} + sign({x}) * 1e-9, 3) + 0.0)"


def sign_label_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN 'positive' WHEN {x} < 0 THEN 'negative' ELSE 'neutral' END)"


def display_label_sql(label: str) -> str:
    d = T.DISPLAY_LABELS
    return (f"(CASE WHEN lower({label}) = 'positive' THEN {q(d['positive'])} "
            f"WHEN lower({label}) = 'negative' THEN {q(d['negative'])} ELSE {q(d['neutral'])} END)")


def lexicon_polarity_sql(src: str, key: str, col: str) -> str:
    """D1 in window form over ``src(key, col)`` -> (key, polarity, n); every key kept."""
    return f"""(
WITH src AS (SELECT {key} AS k, {index_tokens_sql(col)} AS toks FROM {src}),
tk AS (SELECT k, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM src),
lk AS (SELECT tk.k, tk.pos, lx.polarity AS p, lx.intensity AS i,
              coalesce(lx.is_modifier, FALSE) AS m, coalesce(lx.is_negation, FALSE) AS g
       FROM tk LEFT JOIN {lexicon_sql()} lx ON tk.tok = lx.term),
w AS (SELECT *, coalesce(lag(m) OVER wd, FALSE) AS m1, coalesce(lag(g) OVER wd, FALSE) AS g1,
             coalesce(lag(g, 2) OVER wd, FALSE) AS g2, lag(i) OVER wd AS i1, lead(p) OVER wd AS pn
      FROM lk WINDOW wd AS (PARTITION BY k ORDER BY pos)),
a AS (SELECT k, CASE WHEN m1 THEN (CASE WHEN g2
                   THEN greatest(-1.0, least(1.0, p / (CASE WHEN coalesce(i1, 0.0) = 0 THEN 1.0 ELSE i1 END))) * -0.5
                   ELSE greatest(-1.0, least(1.0, p * coalesce(i1, 1.0))) END)
                 WHEN g1 THEN p * -0.5 ELSE p END AS v
      FROM w WHERE p IS NOT NULL AND NOT (m AND pn IS NOT NULL)),
s AS (SELECT k, avg(v) AS avg_v, count(*) AS n FROM a GROUP BY k)
SELECT src.k AS {key}, coalesce({round3_avg_sql('s.avg_v')}, 0.0) AS polarity, coalesce(s.n, 0) AS n
FROM src LEFT JOIN s ON src.k = s.k)"""


def carried_polarity_sql(src: str, key: str, col: str) -> str:
    """D1, second form, read step by step: one step for each word with an entry and each mark; the
    words without an entry between two steps count by the length of the longest."""
    return f"""(
WITH RECURSIVE tk AS (SELECT k, unnest(toks) AS tok, unnest(range(len(toks))) AS pos
       FROM (SELECT {key} AS k, regexp_extract_all(lower(coalesce({col}, '')), {q(WORD_PATTERN)}) AS toks FROM {src})),
lk AS (SELECT k, pos, tok, polarity AS p, coalesce(intensity, 1.0) AS i, coalesce(is_modifier, FALSE) AS m,
              coalesce(is_negation, FALSE) AS g,
              tok = '!' OR polarity IS NOT NULL OR coalesce(is_modifier, FALSE) OR coalesce(is_negation, FALSE) AS known
       FROM tk LEFT JOIN {lexicon_sql()} lx ON tk.tok = lx.term),
mk AS (SELECT *, sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS j FROM lk),
gap AS (SELECT k, j, max(length(tok)) AS len FROM mk WHERE NOT known GROUP BY k, j),
st AS MATERIALIZED (SELECT mk.k, mk.j, mk.tok, mk.p, mk.i, mk.m, mk.g, coalesce(gap.len, 0) AS len
       FROM mk LEFT JOIN gap ON gap.k = mk.k AND gap.j = mk.j - 1 WHERE known),
r AS (
  SELECT {key} AS k, 0 AS j, CAST(0 AS DOUBLE) AS s, 0 AS n, CAST(NULL AS DOUBLE) AS v, FALSE AS own, FALSE AS g, CAST(NULL AS DOUBLE) AS i
  FROM {src}
  UNION ALL
  SELECT k, j,
         CASE WHEN tok <> '!' AND p IS NOT NULL AND NOT (own AND i IS NOT NULL) THEN s + coalesce(v, 0.0) ELSE s END,
         CASE WHEN tok <> '!' AND p IS NOT NULL AND NOT (own AND i IS NOT NULL) THEN n + 1 ELSE n END,
         CASE WHEN tok = '!' THEN CASE WHEN v IS NULL THEN NULL ELSE greatest(-1.0, least(1.0, v * 1.25)) END
              WHEN p IS NULL THEN v
              WHEN i IS NOT NULL AND g THEN greatest(-1.0, least(1.0, p / (CASE WHEN i = 0 THEN 1.0 ELSE i END))) * -0.5
              WHEN i IS NOT NULL THEN greatest(-1.0, least(1.0, p * i))
              WHEN g THEN p * -0.5 ELSE p END,
         CASE WHEN tok = '!' THEN own ELSE p IS NOT NULL AND xm END,
         CASE WHEN tok = '!' THEN g WHEN xm THEN g OR (p IS NULL AND xg) ELSE xg END,
         CASE WHEN tok = '!' THEN i WHEN xm THEN xi END
  FROM (SELECT r.k, CAST(st.j AS INTEGER) AS j, st.tok, st.p, st.i AS xi, st.m AS xm, st.g AS xg, r.s, r.n, r.v,
               r.own AND st.len <= 2 AS own, r.g AND st.len <= 1 AS g, CASE WHEN st.len <= 2 THEN r.i END AS i
        FROM r JOIN st ON st.k = r.k AND st.j = r.j + 1)),
e AS (SELECT k, n, (s + coalesce(v, 0.0)) / n AS mean FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY j DESC) = 1)
SELECT k AS {key}, CASE WHEN n > 0 THEN {round3_avg_sql('mean')} ELSE 0.0 END AS polarity, CAST(n AS BIGINT) AS n FROM e)"""


def ngram_terms_sql(tokens: str) -> str:
    """Uni+bigrams of a token list (DuckDB lists are 1-based)."""
    return (f"list_concat({tokens}, CASE WHEN len({tokens}) > 1 THEN "
            f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]) "
            f"ELSE [] END)")


def tfidf_ctes(prefix: str, corpus: str, key: str, text: str, max_terms: int, queries: str | None = None,
               qkey: str | None = None, qtext: str | None = None) -> str:
    """CTEs ``{p}tf(k, term, tf)``, ``{p}voc(term, total_tf, df, idf)``, ``{p}w(k, term, tf, weight)``
    and, with queries, ``{p}qw(k, term, tf, weight)`` (queries transformed with the corpus vocabulary)."""
    p = prefix
    s = f"""{p}tok AS (SELECT {key} AS k, {index_tokens_sql(text)} AS w FROM {corpus}),
{p}g AS (SELECT k, unnest({ngram_terms_sql('w')}) AS term FROM {p}tok),
{p}tf AS (SELECT k, term, count(*) AS tf FROM {p}g GROUP BY k, term),
{p}n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {corpus}),
{p}voc0 AS (SELECT term, sum(tf) AS total_tf, count(*) AS df FROM {p}tf GROUP BY term
            ORDER BY total_tf DESC, term LIMIT {max_terms}),
{p}voc AS (SELECT v.term, v.total_tf, v.df, ln((1 + {p}n.n) / (1 + v.df)) + 1 AS idf FROM {p}voc0 v, {p}n),
{p}w0 AS (SELECT t.k, t.term, t.tf, t.tf * v.idf AS w FROM {p}tf t JOIN {p}voc v ON t.term = v.term),
{p}w AS (SELECT k, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM {p}w0)"""
    if queries:
        s += f""",
{p}qtok AS (SELECT {qkey} AS k, {index_tokens_sql(qtext)} AS w FROM {queries}),
{p}qg AS (SELECT k, unnest({ngram_terms_sql('w')}) AS term FROM {p}qtok),
{p}qtf AS (SELECT k, term, count(*) AS tf FROM {p}qg GROUP BY k, term),
{p}qw0 AS (SELECT t.k, t.term, t.tf, t.tf * v.idf AS w FROM {p}qtf t JOIN {p}voc v ON t.term = v.term),
{p}qw AS (SELECT k, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM {p}qw0)"""
    return s


def topk_ctes(prefix: str, corpus: str, key: str, queries: str, qkey: str, k: int) -> str:
    """After ``tfidf_ctes`` with queries: ``{p}hits(query_id, rank, doc_id, sim)``."""
    p = prefix
    return f"""{p}pairs AS (SELECT q.k AS query_id, d.k AS doc_id, q.weight * d.weight AS p
                FROM {p}qw q JOIN {p}w d ON q.term = d.term),
{p}pad AS (SELECT {key} AS doc_id FROM {corpus} ORDER BY {key} DESC LIMIT {k}),
{p}cand AS (SELECT query_id, doc_id, p FROM {p}pairs
            UNION ALL SELECT b.{qkey} AS query_id, pad.doc_id, 0.0 AS p FROM {queries} b CROSS JOIN {p}pad pad),
{p}sims AS (SELECT query_id, doc_id, sum(p) AS sim FROM {p}cand GROUP BY query_id, doc_id),
{p}ranked AS (SELECT query_id, doc_id, sim, row_number() OVER (PARTITION BY query_id
              ORDER BY round(sim, 9) DESC, doc_id DESC) AS rank FROM {p}sims),
{p}hits AS (SELECT query_id, rank, doc_id, sim FROM {p}ranked WHERE rank <= {k})"""
