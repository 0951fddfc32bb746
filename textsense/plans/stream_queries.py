"""Structured Streaming queries (S1-S5): each runs a file stream over a driver table with an
``availableNow`` trigger into the shared folder and returns the sink as a table. Their SQL
oracle is the batch form's SQL -- batch and stream must agree on time-ordered input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chatlog as C
from ..operators import lexicon as L
from ..operators.limits import epoch_micros
from ..streaming import streams as ST
from ..streaming.ordered import ordered_cache_hits, ordered_rate_limit
from .chat_queries import LIMIT_N, LIMIT_WINDOW_S, KEEP, SQL as CHAT_SQL
from .fixtures import lexicon_df
from .sqlparts import lexicon_polarity_sql, sign_label_sql
from .text_queries import _POL

QUERIES = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _stream_of(spark, sf, name):
    path = f"{sf.rstrip('/')}/{name}.parquet"
    return ST.table_stream(spark, path, spark.read.parquet(path).schema)


@register("stream_score", f"SELECT doc_id, polarity FROM {_POL}")
def stream_score(spark, sf):
    """Documents arrive as a file stream and are scored in place (stateless)."""
    s = _stream_of(spark, sf, "documents")
    scored = ST.stream_score(s.select("doc_id", "text"), "text", lexicon_df(spark)).select("doc_id", "polarity")
    return ST.run_to_table(scored, spark, "stream-score")


@register("stream_limit", CHAT_SQL["rate_limit"])
def stream_limit(spark, sf):
    """The limiter in event-time order; a user's state is at most 2 admitted requests."""
    s = _stream_of(spark, sf, "events").select("event_id", "user_id", "ts")
    step = ordered_rate_limit("user_id", "ts", "event_id", LIMIT_N, LIMIT_WINDOW_S)
    return step.run(s, name="stream-limit", drain=True).select("event_id", "user_id", "admitted")


@register("stream_cache", CHAT_SQL["cache_hits"])
def stream_cache(spark, sf):
    """S3: cache hits in event-time order; the state is a row per (user, event type)."""
    s = _stream_of(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    step = ordered_cache_hits("user_id", "event_type", "ts", "event_id", F.col("event_type") != "error")
    return step.run(s, name="stream-cache", drain=True).select("event_id", "user_id", "hit")


@register("stream_log", CHAT_SQL["chat_recent"])
def stream_log(spark, sf):
    """Conversation messages stream in; each micro-batch is paired with the messages still
    open, scored and appended to the log, then the newest-200 view is written."""
    lex = lexicon_df(spark)

    def prepare(batch):
        pairs = C.pair_turns(batch)
        scored = L.with_lexicon_polarity(pairs, "user_msg", lex, out="score")
        return (scored.withColumn("sentiment", T.display_label(T.sign_label("score")))
                .withColumn("sources", F.to_json(F.array().cast("array<string>")))
                .select("conv_id", "turn", "user_msg", "bot_msg", "sentiment", "score", "sources"))

    s = _stream_of(spark, sf, "conversations")
    return ST.write_bounded_log(s, spark, ["conv_id", "turn"], KEEP, prepare, "stream-log", C.open_turns)


_WINDOW_SQL = f"""WITH pol AS {lexicon_polarity_sql('benchmark', 'item_id', 'text')},
q AS (SELECT e.ts, {sign_label_sql('pol.polarity')} AS sentiment FROM events e
      JOIN pol ON pol.item_id = CAST(json_extract(e.props, '$.k') AS BIGINT) % (SELECT count(*) FROM benchmark))
SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS window_start, sentiment,
       CAST(count(*) AS BIGINT) AS n
FROM q GROUP BY ALL"""


@register("stream_window_counts", _WINDOW_SQL)
def stream_window_counts(spark, sf):
    """Requests (every event asks the benchmark question that its props number, modulo the
    number of questions) are scored with the lexicon and counted per sentiment in 1-day
    event-time windows."""
    bench = spark.read.parquet(f"{sf.rstrip('/')}/benchmark.parquet")
    n_questions = bench.count()
    scored = L.lexicon_sentiment(bench, "item_id", "text", lexicon_df(spark)).select("item_id", "sentiment")
    # event time: the timestamp_ntz read as UTC wall clock and turned into an instant without
    # the session zone (watermarks need TIMESTAMP); windows on instants are epoch-aligned
    ev = _stream_of(spark, sf, "events")
    s = ev.select(F.timestamp_micros(epoch_micros(ev, "ts")).alias("ts"),
                  (F.get_json_object("props", "$.k").cast("long") % n_questions).alias("item_id"))
    joined = s.join(scored, "item_id")
    counts = ST.stream_label_counts(joined, "ts", "sentiment", "1 day")

    # update mode: the watermark bounds the state, a batch writes the windows it changed
    updates = ST.run_to_table(counts, spark, "stream-window", mode="update", foreach_batch=ST.write_updates)
    table = ST.latest_counts(updates, ["window_start", "window_end", "sentiment"], "n")
    return table.select(F.unix_seconds("window_start").alias("window_start"), "sentiment", "n")
