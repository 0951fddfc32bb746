"""Readers and writers (ids A1-A4, A6, A8; A5/A7 live in ``operators.chatlog``).

All readers are lazy Spark scans; writers are plain DataFrame writes, so partitions are
written in parallel and a failed task is simply re-run.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import chatlog as C

KB_GLOB = "*.{[tT][xX][tT],[mM][dD]}"


class SourceError(ValueError):
    """A read failed (the app shows one generic message for any such failure)."""


def read_csv_text(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", header: bool = True,
                  infer_schema: bool = True, schema: str | None = None, multi_line: bool = True,
                  null_value: str = "\\N") -> DataFrame:
    """A1: delimited text with a header, single-byte Latin-1 decode by default; quoted fields
    may span lines (``multi_line=False`` says that none does: files can then be split). Blanks
    at a field's ends are kept; a field with nothing is null (so is ``null_value``), ``""`` is the
    empty text. Any failure to read -> ``SourceError``."""
    r = (spark.read.option("header", header).option("encoding", encoding).option("multiLine", multi_line)
         .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", null_value).option("emptyValue", ""))
    r = r.schema(schema) if schema else r.option("inferSchema", infer_schema)
    try:
        df = r.csv(path)
        df.schema  # noqa: B018 -- resolve now so a bad path fails here
        return df
    except Exception as exc:  # noqa: BLE001
        raise SourceError("Error reading CSV file") from exc


def require_columns(df: DataFrame, cols) -> DataFrame:
    """A2: fail with a clear message when a required column is missing."""
    missing = [c for c in ([cols] if isinstance(cols, str) else cols) if c not in df.columns]
    if missing:
        raise SourceError(f"Data must contain column(s): {', '.join(missing)}")
    return df


def write_scored(df: DataFrame, path: str, fmt: str = "csv", encoding: str = "UTF-8") -> None:
    """A3: every column, header line, no index; overwrite. A null is written as nothing, the
    empty text as ``""``; blanks at the ends are kept. ``fmt='parquet'`` for tables that stay
    inside Spark."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        (w.option("header", True).option("encoding", encoding).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", "").option("emptyValue", '""').csv(path))
    else:
        w.format(fmt).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A4: one document per ``.txt``/``.md`` file (extension case-insensitive, not recursive),
    id = file name, text stripped (newlines too), empty files dropped. Order by ``id`` where the
    order matters: sorting here would shuffle the texts.

    Unlike a per-file open, Spark decodes bad UTF-8 bytes as U+FFFD instead of skipping the
    file (``read_documents_strict`` skips it)."""
    # (``text()``'s own wholetext argument overrides a reader option, so pass it there)
    raw = spark.read.option("pathGlobFilter", KB_GLOB).text(path, wholetext=True)
    docs = raw.select(F.col("_metadata.file_name").alias("id"), T.strip_ws("value").alias("text"))
    return docs.where(F.col("text") != "")


def read_documents_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4 that skips what it cannot read: (documents as ``read_documents`` gives them, skipped
    files as (id, reason)). A file whose bytes are not UTF-8 is skipped and named, not decoded
    with replacement characters. A file is one value of at most 2 GB, as ``binaryFile`` reads it."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", KB_GLOB).load(path)
    named = raw.select(F.col("_metadata.file_name").alias("id"), F.col("content").cast("string").alias("value"))
    valid = F.is_valid_utf8("value")
    docs = named.where(valid).select("id", T.strip_ws("value").alias("text")).where(F.col("text") != "")
    return docs, named.where(~valid).select("id", F.lit("not UTF-8").alias("reason"))


def log_rows(turns: DataFrame, now: datetime | None = None) -> DataFrame:
    """Answered questions as rows of the chat log, sources as JSON text. ``turns`` needs (id,
    user_msg, bot_msg, sentiment, score, sources array); an answer's own time is its ``created_at``
    if ``turns`` has one, else ``now`` (a naive time is UTC) for all of them."""
    now = now or datetime.now(timezone.utc)
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    own = F.col("created_at") if "created_at" in turns.columns else F.lit(None).cast("timestamp")
    micros = int(now.timestamp()) * 1_000_000 + now.microsecond
    out = (C.with_missing_columns(turns, "sources array<string>")
           .withColumn("created_at", F.coalesce(own, F.timestamp_micros(F.lit(micros))))
           .withColumn("sources", T.sources_json("sources")))
    return out.select("id", "created_at", "user_msg", "bot_msg", "sentiment", "score", "sources")


def append_turns(turns: DataFrame, path: str, now: datetime | None = None) -> None:
    """Append answered questions (``log_rows``) to the chat log (parquet), which keeps all of
    them; ``logstore.append_and_trim`` bounds it."""
    log_rows(turns, now).write.mode("append").parquet(path)


def read_chat_log(spark: SparkSession, path: str, n: int = 200) -> DataFrame:
    """A5: newest n turns by id, oldest first, sources parsed (null/empty -> []). Files of several
    generations may lie in the folder: columns that some (or all) lack are null there (A7)."""
    log = C.with_missing_columns(spark.read.option("mergeSchema", True).parquet(path), "sources string")
    return C.recent_view(log, ["id"], n)


def clear_chat_log(spark: SparkSession, path: str) -> None:
    """Delete every row (the log is rewritten empty, schema kept)."""
    empty = spark.createDataFrame([], "id long, created_at timestamp, user_msg string, bot_msg string, "
                                      "sentiment string, score double, sources string")
    empty.write.mode("overwrite").parquet(path)
