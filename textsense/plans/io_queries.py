"""Source/sink round trips (A1-A4, A6, A8): rows-only checks; they write to the shared
folder named by the session and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chatlog as C
from ..session import shared_path
from ..sources import files as IO
from ..sources import logstore as LOG
from .common import table

QUERIES = {}
SQL = {}

FILE_RECORDS = 500  # texts of a knowledge-base file, which is read back as one value


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("csv_roundtrip", r"""
SELECT doc_id, regexp_full_match(text, '(?s)[\x{0}-\x{FF}]*') AS latin1, regexp_full_match(text, '(?s)[\x{0}-\x{FF}]*') AS same
FROM documents""")
def csv_roundtrip(spark, sf):
    """A3 write (Latin-1, header) then A1 read + A2 column check: per document, whether the
    text came back unchanged (characters outside Latin-1 cannot)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = shared_path(spark, "csv")
    IO.write_scored(d, path, "csv", encoding="ISO-8859-1")
    back = IO.require_columns(IO.read_csv_text(spark, path, schema="doc_id long, lang string, text string"),
                              ["doc_id", "text"])
    latin1 = F.col("a.text").rlike(r"^[\x{0}-\x{FF}]*$")
    j = d.alias("a").join(back.alias("b"), "doc_id")
    return j.select("doc_id", latin1.alias("latin1"), (F.col("a.text") == F.col("b.text")).alias("same"))


_BLANK = r"[\s\x{85}\x{A0}]+"


@register("files_roundtrip", f"""
SELECT CAST(sum(length(regexp_replace(text, '{_BLANK}', '', 'g'))) AS BIGINT) AS n_chars,
       (SELECT CAST(least(200, count(*)) AS BIGINT) FROM conversations u JOIN conversations a
        ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant') AS log_recent,
       CAST(0 AS BIGINT) AS log_after_clear
FROM documents""")
def files_roundtrip(spark, sf):
    """A4 over text files written by Spark (``FILE_RECORDS`` texts in each), then A6 append, A5
    read and A8 clear of a chat log built from the conversations. Characters are counted
    without blanks, which do not depend on how texts fall into files."""
    d = table(spark, sf, "documents").select("text")
    kb = shared_path(spark, "kb")
    # (the writer's bound: a file of a whole scan split would not fit an executor as one value)
    d.write.option("maxRecordsPerFile", FILE_RECORDS).text(kb)
    docs = IO.read_documents(spark, kb)
    log_path = shared_path(spark, "chatlog")
    pairs = C.pair_turns(table(spark, sf, "conversations"))
    turns = pairs.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "user_msg", "bot_msg",
                         F.lit("Neutral 😐").alias("sentiment"), F.lit(0.0).alias("score"),
                         F.array(F.col("conv_id").cast("string")).alias("sources"))
    IO.append_turns(turns, log_path)
    recent = IO.read_chat_log(spark, log_path, 200)
    n_recent = recent.count()
    IO.clear_chat_log(spark, log_path)
    n_after = spark.read.parquet(log_path).count()
    return docs.agg(F.sum(F.length(F.regexp_replace("text", _BLANK, ""))).alias("n_chars")).select(
        "n_chars", F.lit(n_recent).cast("long").alias("log_recent"), F.lit(n_after).cast("long").alias("log_after_clear"))


def _log_turns(spark, sf):
    pairs = C.pair_turns(table(spark, sf, "conversations"))
    return pairs.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "user_msg", "bot_msg",
                        F.lit("Neutral 😐").alias("sentiment"), F.lit(0.0).alias("score"),
                        F.array(F.col("conv_id").cast("string")).alias("sources"))


@register("chat_log_bounded", """
SELECT u.conv_id * 1000000 + u.turn AS id, u.text AS user_msg, a.text AS bot_msg, '["' || u.conv_id || '"]' AS sources
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
ORDER BY id DESC LIMIT 200""")
def chat_log_bounded(spark, sf):
    """A6 + G2 as one step: the answered questions go to the versioned log in two appends (odd
    conversations, then even ones), each of which trims it to the newest 200."""
    turns = _log_turns(spark, sf)
    root = shared_path(spark, "bounded-log")
    odd = F.col("sources")[0].cast("long") % 2 == 1
    LOG.append_and_trim(turns.where(odd), root, 200)
    LOG.append_and_trim(turns.where(~odd), root, 200)
    return LOG.read_log(spark, root).select("id", "user_msg", "bot_msg", "sources")
