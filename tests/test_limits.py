"""G4 limiter and G5 cache: FIXTURES §3 boundary rows, batch = stream, large groups."""

import datetime as dt

import pytest

from textsense.operators import limits as LIM
from textsense.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)


def reqs(spark, times, user=1):
    rows = [(i, user, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "id long, user long, ts timestamp")


def admitted(df):
    return [r["admitted"] for r in df.orderBy("id").collect()]


def test_strict_60s_boundary(spark):
    out = LIM.rate_limit(reqs(spark, [0, 59.999, 60]), "user", "ts", "id", max_n=1, window_s=60)
    assert admitted(out) == [True, False, True]


def test_rejected_not_counted(spark):
    out = LIM.rate_limit(reqs(spark, [0, 30, 61]), "user", "ts", "id", max_n=1, window_s=60)
    assert admitted(out) == [True, False, True]


def test_n_per_window(spark):
    out = LIM.rate_limit(reqs(spark, [0, 1, 2, 3, 60.5, 61, 62]), "user", "ts", "id", max_n=3, window_s=60)
    assert admitted(out) == [True, True, True, False, True, True, True]


def _brute(times, n, w):
    log, out = [], []
    for t in times:
        log = [x for x in log if t - x < w]
        if len(log) < n:
            log.append(t)
            out.append(True)
        else:
            out.append(False)
    return out


def test_matches_brute_force_on_a_hot_key(spark):
    import random
    rnd = random.Random(7)
    times, t = [], 0.0
    for _ in range(3000):
        t += rnd.choice([0.5, 1, 2, 5, 30, 70, 200])
        times.append(round(t, 3))
    out = LIM.rate_limit(reqs(spark, times), "user", "ts", "id", max_n=4, window_s=60, partitions=6)
    assert admitted(out) == _brute(times, 4, 60)


def test_cache_flag_off_never_hits(spark):
    df = spark.createDataFrame([(1, 1, T0, "q", False), (2, 1, T0 + dt.timedelta(seconds=1), "q", False)],
                               "id long, s long, ts timestamp, k string, on boolean")
    out = LIM.cache_hits(df, "s", "k", "ts", "id", "on")
    assert [r["hit"] for r in out.orderBy("id").collect()] == [False, False]


def test_cache_hits_after_first_cached(spark):
    rows = [(1, 1, 0, "q", False), (2, 1, 1, "q", True), (3, 1, 2, "q", False), (4, 1, 3, "q", True),
            (5, 2, 4, "q", True), (6, 1, 5, "other", True)]
    df = spark.createDataFrame([(i, s, T0 + dt.timedelta(seconds=t), k, on) for i, s, t, k, on in rows],
                               "id long, s long, ts timestamp, k string, on boolean")
    out = LIM.cache_hits(df, "s", "k", "ts", "id", "on")
    assert [r["hit"] for r in out.orderBy("id").collect()] == [False, False, False, True, False, False]


def test_stream_limiter_equals_batch_over_several_batches(spark, tmp_path):
    times = [0, 10, 20, 30, 65, 70, 75, 130, 131, 132, 133, 200]
    src = tmp_path / "src"
    # three time-ordered files, one micro-batch each
    for j, chunk in enumerate([times[:4], times[4:8], times[8:]]):
        start = sum(len(c) for c in [times[:4], times[4:8], times[8:]][:j])
        rows = [(start + i, 1, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(chunk)]
        spark.createDataFrame(rows, "id long, user long, ts timestamp").coalesce(1).write.parquet(str(src / f"b{j}"))
    schema = "id long, user long, ts timestamp"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(src)))
    out = ST.stream_rate_limit(stream, "user", "ts", "id", max_n=2, window_s=60)
    table = ST.run_to_table(out, spark, "test-limit")
    got = [r["admitted"] for r in table.orderBy("id").collect()]
    assert got == _brute(times, 2, 60)


@pytest.mark.parametrize("seed, parts", [(1, 7), (2, 3), (3, 16)])
def test_hot_and_cold_keys_across_partitions(spark, seed, parts):
    """One key holds most rows and never pauses (a single session across every range
    partition); other keys interleave, with gaps and equal timestamps."""
    import random
    rnd = random.Random(seed)
    rows, rid = [], 0
    for user, n, steps in [(1, 1500, [0, 0.5, 1, 2]), (2, 300, [0, 5, 61, 100]), (3, 50, [30, 59.999, 60])]:
        t = 0.0
        for _ in range(n):
            t += rnd.choice(steps)
            rows.append((rid, user, round(t, 3)))
            rid += 1
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, u, T0 + dt.timedelta(seconds=t)) for i, u, t in rows],
                               "id long, user long, ts timestamp")
    out = {r["id"]: r["admitted"] for r in
           LIM.rate_limit(df, "user", "ts", "id", max_n=3, window_s=60, partitions=parts).collect()}
    for user in (1, 2, 3):
        mine = sorted((t, i) for i, u, t in rows if u == user)
        expect = _brute([t for t, _ in mine], 3, 60)
        assert [out[i] for _, i in mine] == expect


def test_null_keys_share_a_log_and_longs_stay_exact(spark):
    big = 9007199254740993
    rows = [(i, None if i < 5 else 7, T0 + dt.timedelta(seconds=i), big if i % 2 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp, extra long")
    got = {r["id"]: r for r in LIM.rate_limit(df, "user", "ts", "id", max_n=1, window_s=60).collect()}
    assert [got[i]["admitted"] for i in range(10)] == [i in (0, 5) for i in range(10)]
    assert [got[i]["extra"] for i in range(10)] == [big if i % 2 else None for i in range(10)]


def test_stream_treats_null_keys_alike(spark, tmp_path):
    rows = [(i, None if i % 3 else 1, T0 + dt.timedelta(seconds=i)) for i in range(12)]
    schema = "id long, user long, ts timestamp"
    for j in range(3):
        spark.createDataFrame(rows[4 * j:4 * j + 4], schema).coalesce(1).write.parquet(str(tmp_path / "src" / f"b{j}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(str(tmp_path / "src")))
    out = ST.run_to_table(ST.stream_rate_limit(stream, "user", "ts", "id", 2, 60), spark, "null-keys")
    batch = LIM.rate_limit(spark.createDataFrame(rows, schema), "user", "ts", "id", 2, 60)
    assert {r["id"]: r["admitted"] for r in out.collect()} == {r["id"]: r["admitted"] for r in batch.collect()}
