"""Chat-log operators (ids A5, A7, G1-G3, G7, G8, H5, H6).

Physical notes:

* G1 pairs a user message with the reply at the next turn by an equi-join on
  ``(conv, turn + 1)``, hash-partitioned by both keys, so one huge conversation is spread
  over many tasks (a ``lead`` window would put it in one). This needs consecutive turn
  numbers within a conversation, which is what a chat log has. ``pair_next_turns`` takes any
  turn numbers: a conversation is cut into spans of ``SPAN`` turn numbers, the next message
  is found in the span or is the first one of the next span that has any, so a window holds a
  span's messages, or one row of each span of a conversation.
* G2 global retention is a top-k (``orderBy.limit``: each partition keeps its n newest, one
  task merges n x partitions rows), never a window without a partition.
* G2 per session is ``row_number`` per key; Catalyst's WindowGroupLimit keeps only n rows
  per key and partition before the shuffle, so a hot key ships at most n rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T

CHAT_LOG_SCHEMA = ("id long, created_at timestamp, user_msg string, bot_msg string, "
                   "sentiment string, score double, sources array<string>")
SPAN = 4096  # turn numbers of a conversation that one window looks at


def pair_turns(msgs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text", user_role: str = "user", reply_role: str = "assistant") -> DataFrame:
    """G1: (conv, turn, user_msg, bot_msg) -- a user message and the reply right after it."""
    u = msgs.where(F.col(role) == user_role).select(F.col(conv), F.col(turn), F.col(text).alias("user_msg"))
    a = msgs.where(F.col(role) == reply_role).select(
        F.col(conv), (F.col(turn) - 1).alias(turn), F.col(text).alias("bot_msg"))
    return u.join(a, [conv, turn], "inner")


def pair_next_turns(msgs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", user_role: str = "user", reply_role: str = "assistant",
                    span: int = SPAN) -> DataFrame:
    """G1 for turn numbers with gaps or repeats: (conv, turn, user_msg, bot_msg, reply_turn) -- a user
    message and the reply that is the next message of its conversation. A message that comes
    twice counts once. Different messages of one turn follow each other as question, reply,
    any other; then by text. Rows without a conversation or turn are in no pair. Equal to
    ``pair_turns`` (and its turn + 1) where turns are consecutive."""
    rank = F.when(F.col(role) == user_role, 0).when(F.col(role) == reply_role, 1).otherwise(2)
    m = (msgs.where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
         .select(F.col(conv).alias("__c"), F.floor(F.col(turn) / span).alias("__span"),
                 F.struct(F.col(turn).alias("turn"), rank.alias("rank"), F.col(role).alias("role"), F.col(text).alias("text")).alias("__m"))
         .distinct())
    first = m.groupBy("__c", "__span").agg(F.min("__m").alias("__first"))
    after = first.select("__c", "__span", F.lead("__first").over(Window.partitionBy("__c").orderBy("__span")).alias("__after"))
    inside = m.withColumn("__next", F.lead("__m").over(Window.partitionBy("__c", "__span").orderBy("__m")))
    rows = inside.join(after, ["__c", "__span"]).withColumn("__next", F.coalesce("__next", "__after"))
    pairs = rows.where((F.col("__m.role") == user_role) & (F.col("__next.role") == reply_role))
    return pairs.select(F.col("__c").alias(conv), F.col("__m.turn").alias(turn), F.col("__m.text").alias("user_msg"),
                        F.col("__next.text").alias("bot_msg"), F.col("__next.turn").alias("reply_turn"))


def open_turns(msgs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               user_role: str = "user", reply_role: str = "assistant") -> DataFrame:
    """Messages whose partner is not in ``msgs`` yet: questions without the reply right after
    them, replies without their question. (What ``pair_turns`` would still need.)"""
    side = lambda r, d: msgs.where(F.col(role) == r).select(F.col(conv), (F.col(turn) + d).alias(turn)).distinct()
    q = msgs.where(F.col(role) == user_role).join(side(reply_role, -1), [conv, turn], "left_anti")
    a = msgs.where(F.col(role) == reply_role).join(side(user_role, 1), [conv, turn], "left_anti")
    return q.unionByName(a).select(*msgs.columns)


def message_log(pairs: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """G8 (older app): every question and answer as its own row, unbounded:
    (conv, turn, role, content) -- two rows from each pair, in one pass. A reply's turn is
    ``reply_turn`` if the pairs have it, else the one after the question's."""
    reply = F.col("reply_turn") if "reply_turn" in pairs.columns else F.col(turn) + 1
    both = F.array(F.struct(F.col(turn).alias("t"), F.lit("user").alias("r"), F.col("user_msg").alias("c")),
                   F.struct(reply.alias("t"), F.lit("assistant").alias("r"), F.col("bot_msg").alias("c")))
    return pairs.select(conv, F.explode(both).alias("m")).select(
        conv, F.col("m.t").alias(turn), F.col("m.r").alias("role"), F.col("m.c").alias("content"))


def keep_newest(df: DataFrame, order: list[str], n: int = 200, by: str | None = None) -> DataFrame:
    """The newest ``n`` rows by ``order`` (descending), globally or per ``by``."""
    if by is None:
        return df.orderBy(*[F.desc(c) for c in order]).limit(n)
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def keep_only(df: DataFrame, kept_keys: DataFrame, keys: list[str]) -> DataFrame:
    """H6: rows whose key is in ``kept_keys`` (the SQL ``id IN (subquery)`` delete, as a semi join)."""
    return df.join(kept_keys.select(*keys), keys, "left_semi")


def recent_view(df: DataFrame, order: list[str], n: int = 200, drop: tuple = ("created_at",)) -> DataFrame:
    """Newest n, shown oldest first, without the timestamp; sources parsed, null -> []."""
    out = keep_newest(df, order, n)
    if "sources" in out.columns and dict(out.dtypes)["sources"] == "string":
        out = out.withColumn("sources", T.parse_sources("sources"))
    return out.drop(*[c for c in drop if c in out.columns]).orderBy(*order)


def with_missing_columns(df: DataFrame, schema: str | None = None, defaults: dict | None = None) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks, as a typed null (additive migration)."""
    from pyspark.sql.types import StructType
    st = StructType.fromDDL(schema or CHAT_LOG_SCHEMA)
    for f in st.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit((defaults or {}).get(f.name)).cast(f.dataType))
    return df


def log_stats(log: DataFrame, rag_enabled: bool, web_enabled: bool, kb_docs: DataFrame | None = None) -> DataFrame:
    """History length, enabled flags and knowledge-base size, as one row.

    Both counts come from one aggregation over the union of the two tables' rows."""
    rows = log.select(F.lit(1).alias("__log"), F.lit(0).alias("__kb"))
    if kb_docs is not None:
        rows = rows.unionByName(kb_docs.select(F.lit(0).alias("__log"), F.lit(1).alias("__kb")))
    out = rows.agg(F.coalesce(F.sum("__log"), F.lit(0)).cast("long").alias("chat_history_length"),
                   F.coalesce(F.sum("__kb"), F.lit(0)).cast("long").alias("kb_doc_count"))
    out = out.withColumn("rag_enabled", F.lit(rag_enabled)).withColumn("web_enabled", F.lit(web_enabled))
    return out if kb_docs is not None else out.drop("kb_doc_count")
