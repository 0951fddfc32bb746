"""Structured Streaming forms (ids S1-S5).

* S1 ``stream_score``: stateless -- the lexicon scorer is an in-row expression, so it runs
  unchanged on a streaming DataFrame.
* S2 ``stream_rate_limit``: ``applyInPandasWithState`` keyed by the limiter key; state is at
  most ``max_n`` admitted timestamps; rows of a key inside a micro-batch are folded in
  ``(ts, id)`` order, in one frame (``streaming.ordered`` holds no such frame, and judges rows
  that arrive out of order by their event time).
* S3 ``stream_cache_hits``: keyed state per (session, cache key) = "a cached answer exists".
* S4 ``write_bounded_log``: ``foreachBatch`` writes the batch's log rows, the rows that wait
  for a partner, and the newest-n view, each in a folder of the batch (idempotent).
* S5 ``stream_label_counts``: event-time windows (tumbling, or sliding with ``slide``) with a
  watermark, counts per label.

Batch and stream agree when micro-batches arrive in time order; rows of a key that arrive
after later rows were processed are judged against the state as it is (processing order).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators import chatlog as C
from ..operators.lexicon import with_lexicon_polarity
from ..operators.limits import admit, epoch_micros
from ..session import shared_path


def parquet_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                   max_files: int | None = None) -> DataFrame:
    """A file stream over parquet files (``glob`` selects files inside a folder)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream over a parquet table that is one file or a folder of files (a file source
    watches folders only, and its glob picks files by their own name)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        return parquet_stream(spark, path, schema)
    return parquet_stream(spark, at.getParent().toString(), schema, glob=at.getName())


def latest_counts(updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value of each key among the updates that the batches wrote (column ``epoch``)."""
    return updates.groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))


def write_updates(df: DataFrame, epoch: int, out: str) -> None:
    """A ``foreachBatch`` body for update mode: the batch's changed rows, in its own folder."""
    df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
                 foreach_batch=None) -> DataFrame:
    """Run a stream over everything available now (``availableNow``) into a parquet table
    under the shared checkpoint folder and return that table as a batch DataFrame."""
    out = shared_path(spark, f"{name}-out")
    ckpt = shared_path(spark, f"{name}-ckpt")
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.outputMode(mode).foreachBatch(lambda df, epoch: foreach_batch(df, epoch, out)).start()
    else:
        q = w.outputMode(mode).format("parquet").option("path", out).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    # a stream without any row leaves no file to take the columns from
    if foreach_batch is None and q.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    return (spark.read.schema(stream.schema) if foreach_batch is None else spark.read).parquet(out)


# S1 ----------------------------------------------------------------------------------------
def stream_score(stream: DataFrame, col: str, lexicon: DataFrame, out: str = "polarity") -> DataFrame:
    return with_lexicon_polarity(stream, col, lexicon, out=out)


# S2 ----------------------------------------------------------------------------------------
def stream_rate_limit(stream: DataFrame, key: str, ts: str, id_col: str, max_n: int = 10,
                      window_s: float = 60) -> DataFrame:
    window_us = int(round(window_s * 1_000_000))
    s = stream.withColumn("__t", epoch_micros(stream, ts))
    out_schema = StructType(s.schema.fields + [StructField("admitted", BooleanType(), False)])
    state_schema = "ts array<long>"

    def fold(k, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["__t", id_col], kind="stable")
        log = deque(state.get[0] if state.exists else [])
        admitted = np.array([admit(log, int(t), max_n, window_us) for t in pdf["__t"].to_numpy()], dtype=bool)
        state.update((list(log),))
        pdf["admitted"] = admitted
        yield pdf

    return (s.groupBy(key).applyInPandasWithState(fold, out_schema, state_schema, "append",
                                                  GroupStateTimeout.NoTimeout)
            .drop("__t"))


# S3 ----------------------------------------------------------------------------------------
def stream_cache_hits(stream: DataFrame, session: str, cache_key, ts: str, id_col: str, flag) -> DataFrame:
    key = F.col(cache_key) if isinstance(cache_key, str) else cache_key
    on = F.col(flag) if isinstance(flag, str) else flag
    s = stream.withColumn("__ck", key).withColumn("__on", F.coalesce(on, F.lit(False)))
    out_schema = StructType(s.schema.fields + [StructField("hit", BooleanType(), False)])

    def fold(k, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values([ts, id_col], kind="stable")
        seen = bool(state.get[0]) if state.exists else False
        hits = np.empty(len(pdf), dtype=bool)
        for i, on_ in enumerate(pdf["__on"].to_numpy()):
            hits[i] = bool(on_) and seen
            seen = seen or bool(on_)
        state.update((seen,))
        pdf["hit"] = hits
        yield pdf

    return (s.groupBy(session, "__ck").applyInPandasWithState(fold, out_schema, "seen boolean", "append",
                                                             GroupStateTimeout.NoTimeout)
            .drop("__ck", "__on"))


# S4 ----------------------------------------------------------------------------------------
def bounded_log_writer(order: list[str], n: int = 200, prepare=None, open_rows=None):
    """A ``foreachBatch`` body. Every batch writes folders of its own, named by its number, in
    overwrite mode, so that a batch that is run again leaves the same files:

    * ``log/epoch=<e>``: the log rows made from the batch and the rows left open so far
      (``prepare``; the rows themselves without it);
    * ``open/<e>``: rows that still wait for a partner in a later batch (``open_rows``);
    * ``view/<e>``: the newest n rows of the view before and the new log rows.
    """
    def write(batch: DataFrame, epoch: int, out: str):
        spark = batch.sparkSession
        rows = batch
        if open_rows is not None and epoch > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/open/{epoch - 1}"))
        made = prepare(rows) if prepare else rows
        made.write.mode("overwrite").parquet(f"{out}/log/epoch={epoch}")
        if open_rows is not None:
            open_rows(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/open/{epoch}")
        new = spark.read.schema(made.schema).parquet(f"{out}/log/epoch={epoch}")
        if epoch > 0:
            new = new.unionByName(spark.read.schema(made.schema).parquet(f"{out}/view/{epoch - 1}"))
        C.keep_newest(new, order, n).write.mode("overwrite").parquet(f"{out}/view/{epoch}")
    return write


def write_bounded_log(stream: DataFrame, spark: SparkSession, order: list[str], n: int = 200,
                      prepare=None, name: str = "chatlog", open_rows=None, out: str | None = None,
                      checkpoint: str | None = None) -> DataFrame:
    """Run the stream, keep the bounded view; returns the view. Give ``out`` and
    ``checkpoint`` to go on with an earlier run."""
    checkpoint_is_new = checkpoint is None
    out = out or shared_path(spark, f"{name}-out")
    checkpoint = checkpoint or shared_path(spark, f"{name}-ckpt")
    writer, last = bounded_log_writer(order, n, prepare, open_rows), {}

    def each(df, epoch):
        writer(df, epoch, out)
        last["epoch"] = epoch

    q = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if "epoch" not in last:  # nothing new since the earlier run, or nothing at all
        progress = q.lastProgress
        if progress is None and checkpoint_is_new:
            none = spark.createDataFrame([], stream.schema)
            return prepare(none) if prepare else none
        last["epoch"] = int(progress["batchId"]) - 1 if progress else 0
    return spark.read.parquet(f"{out}/view/{last['epoch']}")


# S5 ----------------------------------------------------------------------------------------
def stream_label_counts(stream: DataFrame, ts: str, label: str, window: str = "1 day",
                        slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    w = F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)
    return (stream.withWatermark(ts, watermark).groupBy(w.alias("w"), F.col(label))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label, "n"))
