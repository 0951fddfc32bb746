"""Sliding-log rate limiter and answer-cache hits (ids G4, G5).

G4 semantics: a request is admitted iff fewer than ``max_n`` *admitted* requests of the same
key lie in the last ``window_s`` seconds (``now - t < window_s``); rejected requests are not
recorded. This is order-dependent, so it is not a window function. Requests with a null key
share one log, like those of any other key.

G4 physical plan:

1. session split -- a request that comes ``window_s`` or more after the previous request of
   its key finds an empty log, so the key's history splits there into independent
   sessions. Found without a per-key window: requests are range-partitioned on
   (key, t, id), so a hot key spans many tasks, and partition edges are stitched with
   one-row-per-partition aggregates (see ``_sessions``);
2. sessions are hash-partitioned by ``(key, session)`` and sorted within partitions, so a
   busy key's sessions spread over tasks;
3. one ``mapInArrow`` pass folds each partition in order, streaming Arrow batches and
   carrying at most ``max_n`` timestamps of state -- no group is ever collected into
   memory, whatever its size. Only a single session with no ``window_s`` gap is processed
   sequentially, which the semantics require: such a key's rows are one task's work.

G5 semantics: a request hits iff the cache flag is on and an earlier request (by ``(ts, id)``)
of the same session with the same cache key had the flag on. Plan: the first flagged
request per (session, key) is an aggregation (partial aggregation map-side, so hot keys
collapse early) joined back on the key -- no per-key ordering needed.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def epoch_micros(df: DataFrame, ts: str) -> F.Column:
    """Microseconds since the epoch. A ``timestamp_ntz`` is read as UTC wall-clock time
    without going through the session time zone (a cast would shift it, and by a different
    amount across daylight-saving changes)."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _columns(batch, *names) -> list:
    """Columns of an Arrow batch as Python lists (nulls are None, longs stay exact)."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _with_column(batch, name: str, values: list, kind):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, name])


def admit(log: deque, t: int, max_n: int, window_us: int) -> bool:
    """One step of the sliding log: forget what is out of the window, admit below ``max_n``."""
    while log and t - log[0] >= window_us:
        log.popleft()
    if len(log) >= max_n:
        return False
    log.append(t)
    return True


def _fold_partition(key: str, max_n: int, window_us: int):
    def run(batches):
        import pyarrow as pa
        cur, log = object(), deque()
        for batch in batches:
            out = []
            for k, sess, t in zip(*_columns(batch, key, "__sess", "__t")):
                if (k, sess) != cur:
                    cur, log = (k, sess), deque()
                out.append(admit(log, t, max_n, window_us))
            yield _with_column(batch, "admitted", out, pa.bool_())
    return run


def _session_starts(boundary: dict, key: str, window_us: int):
    """Pass 1 over range partitions sorted by (key, t, id): ``__sl`` = start time of the
    row's session when it starts inside this partition, null for the leading rows that
    continue a session begun in an earlier partition."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        prev_k, prev_t = boundary.get(TaskContext.get().partitionId(), (None, None))
        sess = None
        for batch in batches:
            out = []
            for k, t in zip(*_columns(batch, key, "__t")):
                if prev_t is None or k != prev_k:
                    sess = t          # first request of this key overall
                elif t - prev_t >= window_us:
                    sess = t
                out.append(sess)
                prev_k, prev_t = k, t
            yield _with_column(batch, "__sl", out, pa.int64())
    return run


def _sessions(r: DataFrame, key: str, id_col: str, window_us: int, n: int) -> DataFrame:
    """Session id (start time) per request, computed without putting a key in one task.

    Requests are range-partitioned on (key, t, id) -- the sampled bounds split a hot key
    over many partitions -- and materialised in the shared checkpoint folder so the
    passes below see the same partitions. Partition edges need two facts from earlier
    partitions: the last request before a partition (for the gap test) and the session
    still open at its end (for rows that continue it). Both come from aggregates with one
    row per partition, resolved in partition order on the driver."""
    from ..session import bounded_rows, materialize
    pid = F.spark_partition_id()
    r = materialize(r.repartitionByRange(n, key, "__t", id_col).sortWithinPartitions(key, "__t", id_col))
    ends = bounded_rows(r.groupBy(pid.alias("p")).agg(
        F.min(F.struct(F.col(key).alias("k"), F.col("__t").alias("t"))).alias("f"),
        F.max(F.struct(F.col(key).alias("k"), F.col("__t").alias("t"))).alias("l")), 10 * n + 10, "partition ends")
    ends = sorted(ends, key=lambda x: x["p"])
    boundary, last = {}, None
    for e in ends:
        if last is not None and last["k"] == e["f"]["k"]:
            boundary[e["p"]] = (last["k"], last["t"])
        last = e["l"]
    schema = StructType(r.schema.fields + [StructField("__sl", LongType(), True)])
    p1 = materialize(r.mapInArrow(_session_starts(boundary, key, window_us), schema))
    starts = {x["p"]: x["m"] for x in bounded_rows(
        p1.where(F.col("__sl").isNotNull()).groupBy(pid.alias("p"))
          .agg(F.max(F.struct(F.col(key).alias("k"), F.col("__sl").alias("s"))).alias("m")),
        10 * n + 10, "session starts")}
    carry_in, open_sess = {}, None       # open_sess = (key, session start) at the end of the previous partition
    for e in ends:
        p, first_k, last_k = e["p"], e["f"]["k"], e["l"]["k"]
        cin = open_sess[1] if open_sess is not None and open_sess[0] == first_k else None
        if cin is not None:
            carry_in[p] = cin
        m = starts.get(p)
        open_sess = (last_k, m["s"]) if m is not None and m["k"] == last_k else (last_k, cin)
    fill = F.lit(None).cast("long")
    if carry_in:
        lookup = F.create_map(*[x for kv in carry_in.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        fill = lookup[pid]
    return p1.withColumn("__sess", F.coalesce(F.col("__sl"), fill)).drop("__sl")


def rate_limit(reqs: DataFrame, key: str, ts: str, id_col: str, max_n: int = 10,
               window_s: float = 60, partitions: int | None = None) -> DataFrame:
    """``reqs`` plus a boolean ``admitted`` column.

    Every column of ``reqs`` passes through the Python passes and Catalyst cannot prune
    across them: select the columns you need first."""
    if max_n < 1:
        raise ValueError("max_n must be at least 1")
    window_us = int(round(window_s * 1_000_000))
    n = partitions or int(reqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = _sessions(reqs.withColumn("__t", epoch_micros(reqs, ts)), key, id_col, window_us, n)
    r = r.repartition(n, key, "__sess").sortWithinPartitions(key, "__sess", "__t", id_col)
    schema = StructType(r.schema.fields + [StructField("admitted", BooleanType(), False)])
    return r.mapInArrow(_fold_partition(key, max_n, window_us), schema).drop("__t", "__sess")


def cache_hits(reqs: DataFrame, session: str, cache_key, ts: str, id_col: str, flag) -> DataFrame:
    """``reqs`` plus a boolean ``hit`` column. ``cache_key``/``flag`` are column names
    or Columns."""
    key = F.col(cache_key) if isinstance(cache_key, str) else cache_key
    on = F.col(flag) if isinstance(flag, str) else flag
    r = reqs.withColumn("__ck", key).withColumn("__on", F.coalesce(on, F.lit(False)))
    first = (r.where(F.col("__on")).groupBy(session, "__ck")
             .agg(F.min(F.struct(F.col(ts).alias("t"), F.col(id_col).alias("i"))).alias("__first")))
    j = r.join(first, [session, "__ck"], "left")
    f = F.col("__first")
    earlier = (f["t"] < F.col(ts)) | ((f["t"] == F.col(ts)) & (f["i"] < F.col(id_col)))
    return (j.withColumn("hit", F.col("__on") & F.coalesce(earlier, F.lit(False)))
             .drop("__ck", "__on", "__first"))
