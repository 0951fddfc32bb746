"""Limiter and cache over streams whose rows arrive out of order (ids S2, S3).

Rows wait until the watermark (the greatest event time seen, less ``delay_s``) has passed them and
are then judged in event-time order by the batch operators of ``operators.limits``: requests
are range-partitioned and folded there by Arrow batches, so no frame holds a key's micro-batch.
What a key carries from batch to batch is rows of a stored table:

* limiter: its admitted requests inside the window before the watermark, ``max_n`` at most. They
  are judged once more with the new rows, which admits all of them again: the log holds admitted
  requests only;
* cache: the last flagged request of each (session, cache key), forgotten ``keep_s`` after it if
  that is given. Answers equal the batch form's for requests less than ``keep_s`` after a flagged
  one; without ``keep_s`` nothing is forgotten, and they always do.

A batch writes folders of its own, named by its number, in overwrite mode; it reads those of the
batch before. So a batch that is run again, and a stream that goes on from its checkpoint, leave
the same tables:

* ``judged/epoch=<e>``: the rows the watermark has passed, with their answer;
* ``late/epoch=<e>``: rows behind the watermark when they came (or without a time). They are not
  judged; the table counts them;
* ``waiting/epoch=<e>``, ``state/epoch=<e>``, ``clock/epoch=<e>``: what the next batch goes on with.

A batch reads and writes the whole state, which the window or ``keep_s`` bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.limits import cache_hits, epoch_micros, rate_limit
from ..session import shared_path

EARLIEST = -(1 << 62)


def _micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


@dataclass
class OrderedStep:
    """``judge`` adds the answer to rows (carried ones among them, told by ``__old``);
    ``carry`` picks from judged rows those that rows at or after a watermark (microseconds) need."""

    ts: str
    delay_s: float
    judge: Callable[[DataFrame], DataFrame]
    carry: Callable[[DataFrame, int], DataFrame]

    def write(self, batch: DataFrame, epoch: int, out: str) -> None:
        """A ``foreachBatch`` body."""
        spark = batch.sparkSession

        def put(df, name):
            path = f"{out}/{name}/epoch={epoch}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        came = put(batch.withColumn("__t", epoch_micros(batch, self.ts)), "came")
        passed, waiting, state = self.before(spark, out, epoch, came)
        newest = came.agg(F.max("__t")).first()[0]
        mark = passed if newest is None else max(passed, newest - _micros(self.delay_s))
        on_time = F.coalesce(F.col("__t") >= passed, F.lit(False))
        put(came.where(~on_time).drop("__t"), "late")
        rows = came.where(on_time).unionByName(waiting)
        put(rows.where(F.col("__t") >= mark), "waiting")
        judged = put(self.judged(rows.where(F.col("__t") < mark), state), "work")
        put(judged.where("not __old").drop("__old", "__t"), "judged")
        put(self.carry(judged, mark).select(*came.columns), "state")
        put(spark.range(1).select(F.lit(mark).cast("long").alias("mark")), "clock")

    def before(self, spark: SparkSession, out: str, epoch: int, like: DataFrame):
        """Watermark, waiting rows and state that the batch before ``epoch`` left."""
        if epoch == 0:
            return EARLIEST, like.limit(0), like.limit(0)
        at = lambda name: f"{out}/{name}/epoch={epoch - 1}"
        read = spark.read.schema(like.schema)
        return spark.read.parquet(at("clock")).first()["mark"], read.parquet(at("waiting")), read.parquet(at("state"))

    def judged(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        return self.judge(rows.withColumn("__old", F.lit(False)).unionByName(state.withColumn("__old", F.lit(True))))

    def run(self, stream: DataFrame, out: str | None = None, checkpoint: str | None = None, name: str = "ordered",
            drain: bool = False) -> DataFrame:
        """Run over everything available now and return all judged rows. Give ``out`` and
        ``checkpoint`` to go on with an earlier run. ``drain`` adds the rows that still wait, judged
        as if nothing came before them any more; the tables stay as they are."""
        spark = stream.sparkSession
        out, checkpoint = out or shared_path(spark, f"{name}-out"), checkpoint or shared_path(spark, f"{name}-ckpt")
        q = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda df, epoch: self.write(df, epoch, out)).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        schema = stream.withColumn("__t", F.lit(0).cast("long"))
        empty = spark.createDataFrame([], schema.schema)
        try:
            last = spark.read.parquet(f"{out}/clock").agg(F.max("epoch")).first()[0]
        except AnalysisException:  # no batch has run: the stream had no rows yet
            return self.judged(empty, empty).drop("__old", "__t")
        answers = spark.read.parquet(f"{out}/judged").drop("epoch")
        if not drain:
            return answers
        _, waiting, state = self.before(spark, out, int(last) + 1, empty)
        return answers.unionByName(self.judged(waiting, state).where("not __old").drop("__old", "__t"))


def ordered_rate_limit(key: str, ts: str, id_col: str, max_n: int = 10, window_s: float = 60,
                       delay_s: float = 0) -> OrderedStep:
    """Adds ``admitted`` as the batch limiter would to the rows in event-time order."""
    def judge(rows):
        return rate_limit(rows, key, ts, id_col, max_n, window_s).withColumn("__t", epoch_micros(rows, ts))

    def carry(judged, mark):
        return judged.where(F.col("admitted") & (F.col("__t") > mark - _micros(window_s)))
    return OrderedStep(ts, delay_s, judge, carry)


def ordered_cache_hits(session: str, cache_key: str | Column, ts: str, id_col: str, flag: str | Column,
                       delay_s: float = 0, keep_s: float | None = None) -> OrderedStep:
    """S3: adds ``hit`` as the batch form would to the rows in event-time order."""
    on = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
    key = F.col(cache_key) if isinstance(cache_key, str) else cache_key

    def judge(rows):
        return cache_hits(rows, session, cache_key, ts, id_col, flag)

    def carry(judged, mark):
        kept = judged.where(on)
        if keep_s is not None:
            kept = kept.where(F.col("__t") > mark - _micros(keep_s))
        row = F.struct(*[F.col(c) for c in judged.columns])
        return kept.groupBy(F.col(session).alias("__s"), key.alias("__k")) \
                   .agg(F.max_by(row, F.struct("__t", id_col)).alias("r")).select("r.*")
    return OrderedStep(ts, delay_s, judge, carry)
