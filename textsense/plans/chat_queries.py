"""Queries over the chat log (conversations) and the request stream (events): A5, A7, C13,
D9, G1-G5, G7, G8, H5, H6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chatlog as C
from ..operators import lexicon as L
from ..operators import limits as LIM
from ..session import shared_path, stored
from ..sources import files as IO
from .common import table
from .fixtures import lexicon_df
from .sqlparts import display_label_sql, lexicon_polarity_sql, sign_label_sql

QUERIES = {}
SQL = {}

KEEP = 200
PER_SESSION = 2
LIMIT_N = 2
LIMIT_WINDOW_S = 86_400


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


_PAIRS_SQL = """pairs AS (SELECT u.conv_id, u.turn, u.text AS user_msg, a.text AS bot_msg
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

_LOG_SQL = _PAIRS_SQL + f""",
pol AS {lexicon_polarity_sql('(SELECT conv_id * 1000000 + turn AS pid, user_msg FROM pairs)', 'pid', 'user_msg')},
chatlog AS (SELECT p.conv_id, p.turn, p.user_msg, p.bot_msg,
       {display_label_sql(sign_label_sql('pol.polarity'))} AS sentiment, pol.polarity AS score,
       CAST(NULL AS VARCHAR) AS sources
  FROM pairs p JOIN pol ON pol.pid = p.conv_id * 1000000 + p.turn)"""


def _pairs(spark, sf):
    return C.pair_next_turns(table(spark, sf, "conversations"))


def _chat_log(spark, sf):
    """The chat log as the app keeps it, from the conversations: one row per answered
    question, lexicon sentiment of the question (D9), no sources yet (added by A7)."""
    pairs = _pairs(spark, sf)
    scored = L.with_lexicon_polarity(pairs, "user_msg", lexicon_df(spark), out="score")
    log = scored.withColumn("sentiment", T.display_label(T.sign_label("score")))
    return C.with_missing_columns(log, "sources string")


@register("chat_sentiment", f"""
WITH {_LOG_SQL}
SELECT conv_id, turn, sentiment, score FROM chatlog""")
def chat_sentiment(spark, sf):
    return _chat_log(spark, sf).select("conv_id", "turn", "sentiment", "score")


@register("chat_recent", f"""
WITH {_LOG_SQL},
kept AS (SELECT conv_id, turn FROM chatlog ORDER BY conv_id DESC, turn DESC LIMIT {KEEP})
SELECT c.conv_id, c.turn, c.user_msg, c.bot_msg, c.sentiment, c.score,
       CAST(to_json(coalesce(CAST(c.sources AS JSON)::VARCHAR[], [])) AS VARCHAR) AS sources
FROM chatlog c SEMI JOIN kept k ON k.conv_id = c.conv_id AND k.turn = c.turn""")
def chat_recent(spark, sf):
    """A5 + G2 + G3 + H5 + H6: retention (keep the newest 200 by id, as a semi join with
    the top-200 keys), then the recent view, oldest first, sources parsed."""
    log = stored(_chat_log(spark, sf), "chatlog")
    keys = ["conv_id", "turn"]
    retained = C.keep_only(log, C.keep_newest(log.select(*keys), keys, KEEP), keys)
    view = C.recent_view(retained, keys, KEEP)
    return view.select("conv_id", "turn", "user_msg", "bot_msg", "sentiment", "score",
                       F.to_json("sources").alias("sources"))


@register("chat_recent_per_session", f"""
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= {PER_SESSION}""")
def chat_recent_per_session(spark, sf):
    """G2 per session: the newest 2 messages of every conversation."""
    c = table(spark, sf, "conversations")
    return C.keep_newest(c, ["turn"], PER_SESSION, by="conv_id").select("conv_id", "turn", "role", "text")


@register("chat_sources_json", "WITH " + _PAIRS_SQL + """
SELECT conv_id, turn, CAST(to_json(coalesce(CAST(NULL AS VARCHAR[]), [])) AS VARCHAR) AS migrated,
       CAST(len(w) AS BIGINT) AS n_sources, CAST(to_json(w) AS VARCHAR) AS sources
FROM (SELECT conv_id, turn, regexp_extract_all(bot_msg, '[\\p{L}]{10,}') AS w FROM pairs)""")
def chat_sources_json(spark, sf):
    """A7 + C13: the log gains a nullable ``sources`` column (null -> []); a list of names
    (long words of the answer) goes to JSON text and back unchanged."""
    pairs = C.with_missing_columns(_pairs(spark, sf), "sources string")
    words = F.regexp_extract_all("bot_msg", F.lit(r"[\p{L}]{10,}"), 0)
    enc = pairs.withColumn("__json", T.sources_json(words))
    dec = enc.withColumn("__back", T.parse_sources("__json"))
    return dec.select("conv_id", "turn", F.to_json(T.parse_sources("sources")).alias("migrated"),
                      F.size("__back").cast("long").alias("n_sources"), F.to_json("__back").alias("sources"))


@register("chat_message_log", _PAIRS_SQL.replace("pairs AS", "WITH pairs AS", 1) + """
SELECT conv_id, turn, 'user' AS role, user_msg AS content FROM pairs
UNION ALL SELECT conv_id, turn + 1 AS turn, 'assistant' AS role, bot_msg AS content FROM pairs""")
def chat_message_log(spark, sf):
    return C.message_log(_pairs(spark, sf))


@register("log_stats", _PAIRS_SQL.replace("pairs AS", "WITH pairs AS", 1) + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM pairs) AS chat_history_length,
       (SELECT CAST(count(*) AS BIGINT) FROM documents) AS kb_doc_count,
       TRUE AS rag_enabled, FALSE AS web_enabled""")
def log_stats(spark, sf):
    return C.log_stats(_pairs(spark, sf), True, False, table(spark, sf, "documents", spread_rows=False))


def _limit_sql(src: str, n: int, window_s: int) -> str:
    """G4 as a recursive CTE carrying each key's list of admitted times (oracle only)."""
    w = window_s * 1_000_000
    return f"""ev AS (SELECT user_id, event_id, epoch_us(ts) AS t,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {src}),
lim AS (WITH RECURSIVE r(user_id, rn, event_id, admitted, win) AS (
    SELECT user_id, rn, event_id, TRUE, [t] FROM ev WHERE rn = 1
    UNION ALL
    SELECT e.user_id, e.rn, e.event_id,
           len(list_filter(r.win, lambda x: e.t - x < {w})) < {n},
           CASE WHEN len(list_filter(r.win, lambda x: e.t - x < {w})) < {n}
                THEN list_append(list_filter(r.win, lambda x: e.t - x < {w}), e.t)
                ELSE list_filter(r.win, lambda x: e.t - x < {w}) END
    FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
  SELECT user_id, event_id, admitted FROM r)"""


@register("rate_limit", f"""
WITH {_limit_sql('events', LIMIT_N, LIMIT_WINDOW_S)}
SELECT event_id, user_id, admitted FROM lim""")
def rate_limit(spark, sf):
    """G4 on events per user: at most 2 admitted per 86,400 s (the 60 s horizon never binds on
    this data: ~67 events per user over 30 days)."""
    # only the needed columns go through the Python fold (nothing is pruned across it)
    e = table(spark, sf, "events", spread_rows=False).select("event_id", "user_id", "ts")
    out = LIM.rate_limit(e, "user_id", "ts", "event_id", LIMIT_N, LIMIT_WINDOW_S)
    return out.select("event_id", "user_id", "admitted")


@register("cache_hits", """
SELECT event_id, user_id,
       coalesce(event_type <> 'error' AND max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (
         PARTITION BY user_id, event_type ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, FALSE) AS hit
FROM events""")
def cache_hits(spark, sf):
    """G5 with session = user, cache key = event type, cache flag on unless the event is an error."""
    e = table(spark, sf, "events", spread_rows=False)
    out = LIM.cache_hits(e, "user_id", "event_type", "ts", "event_id", F.col("event_type") != "error")
    return out.select("event_id", "user_id", "hit")


# --- G6: the request flow -------------------------------------------------------------------

def _requests_sql() -> str:
    from .retrieval_queries import MAX_TERMS, TOP_K
    from .sqlparts import tfidf_ctes, topk_ctes, strip_ws_sql
    req = f"""req AS (SELECT e.event_id, e.user_id, e.ts, e.event_type, b.item_id, b.text AS query
  FROM events e JOIN benchmark b
    ON b.item_id = CAST(json_extract(e.props, '$.k') AS BIGINT) % (SELECT count(*) FROM benchmark)
  WHERE length({strip_ws_sql('b.text')}) > 0)"""
    return f"""WITH {req},
{_limit_sql('req', LIMIT_N, LIMIT_WINDOW_S)},
adm AS (SELECT r.* FROM req r JOIN lim ON lim.event_id = r.event_id WHERE lim.admitted),
pol AS {lexicon_polarity_sql('benchmark', 'item_id', 'text')},
hits0 AS (SELECT a.*, coalesce(event_type <> 'error' AND max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id, query ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, FALSE) AS hit FROM adm a),
{tfidf_ctes('c_', 'documents', 'doc_id', 'text', MAX_TERMS, 'benchmark', 'item_id', 'text')},
{topk_ctes('c_', 'documents', 'doc_id', 'benchmark', 'item_id', TOP_K)},
src AS (SELECT query_id, CAST(to_json(list(CAST(doc_id AS VARCHAR) ORDER BY rank)) AS VARCHAR) AS sources
         FROM c_hits GROUP BY query_id)
SELECT e.event_id, e.user_id,
       CASE WHEN h.event_id IS NOT NULL THEN 'answered' WHEN r.event_id IS NOT NULL THEN 'rate_limited' ELSE 'blank' END AS status,
       CASE WHEN h.event_id IS NOT NULL THEN {display_label_sql(sign_label_sql('pol.polarity'))} END AS sentiment,
       CASE WHEN h.event_id IS NOT NULL THEN pol.polarity END AS score, h.hit,
       CASE WHEN h.event_id IS NOT NULL THEN src.sources END AS sources
FROM events e LEFT JOIN req r ON r.event_id = e.event_id LEFT JOIN hits0 h ON h.event_id = e.event_id
     LEFT JOIN pol ON pol.item_id = h.item_id LEFT JOIN src ON src.query_id = h.item_id"""


@register("request_flow", _requests_sql())
def request_flow(spark, sf):
    """G6 on the request stream: every event asks the benchmark question that its props number
    (``{"k": n}``, modulo the number of questions); 2 requests per user per 86,400 s; cache flag
    on unless the event is an error; top-3 documents as sources. The answered rows are appended
    to a chat log (A6) whose size the tests check."""
    from ..operators import requests as RQ
    from ..operators import retrieve as R
    from .retrieval_queries import MAX_TERMS, TOP_K
    b = table(spark, sf, "benchmark", spread_rows=False).select("item_id", "text")
    n = b.count()
    e = table(spark, sf, "events", spread_rows=False)
    k = F.get_json_object("props", "$.k").cast("long")
    reqs = e.select("event_id", "user_id", "ts", "event_type", (k % n).alias("item_id"))
    d = table(spark, sf, "documents")
    index = R.build_index(d, "doc_id", "text", MAX_TERMS)
    flow = stored(RQ.run_requests(reqs, "user_id", "ts", "event_id", "item_id", b, "item_id", "text", index, d, "doc_id", "text",
                                  lexicon_df(spark), LIMIT_N, LIMIT_WINDOW_S, True, TOP_K, False, 3,
                                  F.col("event_type") != "error"), "flow")
    IO.append_turns(RQ.log_turns(flow, b, "item_id", "text", reqs, "item_id", "event_id", "ts"), shared_path(spark, "chatlog"))
    return flow.select("event_id", "user_id", "status", "sentiment", "score", "hit", F.to_json("sources").alias("sources"))
