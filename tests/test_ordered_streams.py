"""S2 and S3 over shuffled arrivals: equal to the batch form, late rows counted, state bounded."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textsense.operators import limits as LIM
from textsense.streaming import ordered as O

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, user long, ts timestamp, k string, on boolean"


def requests(n=400, seed=3):
    """Requests in time order, seconds apart, with equal times, a busy user and a null user."""
    rnd, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 2, 5])
        out.append((i, rnd.choice([1, 1, 1, 2, 3, None]), T0 + dt.timedelta(seconds=t), rnd.choice("ab"), rnd.random() < 0.6))
    return out


def shuffled(rows, spread=30, seed=4):
    """Arrival order: a row comes at most ``spread`` seconds of event time after a later one."""
    rnd = random.Random(seed)
    return sorted(rows, key=lambda r: (r[2] - T0).total_seconds() + rnd.random() * spread)


def put(spark, src, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / name))


def stream_of(spark, src):
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(str(src)))


def answers(df, col):
    rows = df.select("id", col).collect()
    out = {r["id"]: r[col] for r in rows}
    assert len(out) == len(rows)
    return out


def test_limiter_with_shuffled_arrival_and_a_restart_equals_batch(spark, tmp_path):
    rows = requests()
    came, src = shuffled(rows), tmp_path / "src"
    step = O.ordered_rate_limit("user", "ts", "id", 2, 20, delay_s=30)
    parts = [came[:150], came[150:260], came[260:]]
    for j, part in enumerate(parts[:2]):
        put(spark, src, f"b{j}", part)
    args = (str(tmp_path / "out"), str(tmp_path / "ckpt"))
    half = step.run(stream_of(spark, src), *args)
    put(spark, src, "b2", parts[2])
    got = step.run(stream_of(spark, src), *args, drain=True)
    want = answers(LIM.rate_limit(spark.createDataFrame(rows, SCHEMA), "user", "ts", "id", 2, 20), "admitted")
    assert answers(got, "admitted") == want and 50 < sum(want.values()) < 350
    assert 0 < half.count() < 260  # a drain leaves the tables as they are
    assert spark.read.parquet(str(tmp_path / "out" / "late")).count() == 0
    # nothing new: the same answers; what waits is judged only when the watermark has passed it
    assert answers(step.run(stream_of(spark, src), *args, drain=True), "admitted") == want
    state = spark.read.parquet(str(tmp_path / "out" / "state"))
    assert state.groupBy("epoch", "user").count().agg(F.max("count")).first()[0] <= 2


def test_late_rows_are_counted_and_not_judged(spark, tmp_path):
    src = tmp_path / "src"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    put(spark, src, "b0", [(1, 7, at(0), "a", True), (2, 7, at(100), "a", True)])
    put(spark, src, "b1", [(3, 7, at(89), "a", True), (4, 7, at(90), "a", True), (5, 7, None, "a", True)])
    step = O.ordered_rate_limit("user", "ts", "id", 1, 20, delay_s=10)  # the watermark is 90 after b0
    out = str(tmp_path / "out")
    got = answers(step.run(stream_of(spark, src), out, str(tmp_path / "c"), drain=True), "admitted")
    assert got == {1: True, 4: True, 2: False}
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/late").collect()) == [3, 5]


def test_a_batch_run_again_leaves_the_same_tables(spark, tmp_path):
    rows = shuffled(requests(120))
    step, out = O.ordered_rate_limit("user", "ts", "id", 2, 20, delay_s=30), str(tmp_path)
    for epoch, part in [(0, rows[:60]), (1, rows[60:]), (1, rows[60:])]:
        step.write(spark.createDataFrame(part, SCHEMA), epoch, out)
    once = spark.read.parquet(f"{out}/judged")
    assert once.count() == once.select("id").distinct().count() > 0
    assert once.count() + spark.read.parquet(f"{out}/waiting/epoch=1").count() == 120


@pytest.mark.parametrize("keep_s", [None, 10_000])
def test_cache_with_shuffled_arrival_equals_batch(spark, tmp_path, keep_s):
    rows = requests(300, 8)
    came, src = shuffled(rows), tmp_path / "src"
    for j in range(3):
        put(spark, src, f"b{j}", came[j * 100:(j + 1) * 100])
    step = O.ordered_cache_hits("user", "k", "ts", "id", "on", delay_s=30, keep_s=keep_s)
    got = answers(step.run(stream_of(spark, src), str(tmp_path / "o"), str(tmp_path / "c"), drain=True), "hit")
    want = answers(LIM.cache_hits(spark.createDataFrame(rows, SCHEMA), "user", "k", "ts", "id", "on"), "hit")
    assert got == want and 0 < sum(want.values()) < 300


def test_state_of_many_keys_is_bounded_by_the_horizon(spark, tmp_path):
    src = tmp_path / "src"
    for j in range(3):  # 200 keys a batch that never come again, 1,000 s apart
        put(spark, src, f"b{j}", [(j * 200 + i, j * 200 + i, T0 + dt.timedelta(seconds=1000 * j + i), "a", True) for i in range(200)])
    for name, step in [("cache", O.ordered_cache_hits("user", "k", "ts", "id", "on", keep_s=300)),
                       ("limit", O.ordered_rate_limit("user", "ts", "id", 3, 300))]:
        out = str(tmp_path / name)
        assert step.run(stream_of(spark, src), out, f"{out}-c", drain=True).count() == 600
        sizes = [r["count"] for r in spark.read.parquet(f"{out}/state").groupBy("epoch").count().collect()]
        assert len(sizes) == 3 and max(sizes) <= 200


def test_empty_stream(spark, tmp_path):
    put(spark, tmp_path / "src", "b0", [])
    step = O.ordered_rate_limit("user", "ts", "id", 2, 20)
    got = step.run(stream_of(spark, tmp_path / "src"), str(tmp_path / "o"), str(tmp_path / "c"), drain=True)
    assert got.count() == 0 and "admitted" in got.columns
