"""Streamed cache hits equal the batch form over several micro-batches; sliding
windows count every row once per window it falls in."""

import datetime as dt

from pyspark.sql import functions as F

from textsense.operators import limits as LIM
from textsense.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, s long, ts timestamp, k string, on boolean"


def _rows():
    import random
    rnd = random.Random(5)
    out, t = [], 0
    for i in range(300):
        t += rnd.choice([1, 2, 3])
        out.append((i, rnd.choice([1, 2, 3]), T0 + dt.timedelta(seconds=t), rnd.choice("abc"), rnd.random() < 0.7))
    return out


def test_stream_cache_equals_batch(spark, tmp_path):
    rows = _rows()
    src = tmp_path / "src"
    for j in range(3):   # three time-ordered files -> three micro-batches
        part = rows[j * 100:(j + 1) * 100]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(src / f"b{j}"))
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(src)))
    got = ST.run_to_table(ST.stream_cache_hits(stream, "s", "k", "ts", "id", "on"), spark, "test-cache")
    batch = LIM.cache_hits(spark.createDataFrame(rows, SCHEMA), "s", "k", "ts", "id", "on")
    a = {r["id"]: r["hit"] for r in got.collect()}
    b = {r["id"]: r["hit"] for r in batch.collect()}
    assert a == b and sum(b.values()) > 50


def test_sliding_window_counts(spark):
    rows = [(T0 + dt.timedelta(seconds=s), "x") for s in (0, 10, 29, 30, 59, 61)]
    df = spark.createDataFrame(rows, "ts timestamp, label string")
    out = ST.stream_label_counts(df, "ts", "label", "60 seconds", "30 seconds")
    got = {(r["window_start"] - T0).total_seconds(): r["n"] for r in out.collect()}
    assert got == {-30.0: 3, 0.0: 5, 30.0: 3, 60.0: 1}


def _messages():
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}-{t}") for t in range(8) for c in (1, 2)]


def _log(spark, src, out, ckpt):
    from textsense.operators import chatlog as C
    schema = "conv_id long, turn long, role string, text string"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src)))
    return ST.write_bounded_log(stream, spark, ["conv_id", "turn"], 5, C.pair_turns, "t", C.open_turns, str(out), str(ckpt))


def test_log_of_single_messages_equals_batch_also_after_restart(spark, tmp_path):
    from textsense.operators import chatlog as C
    schema = "conv_id long, turn long, role string, text string"
    rows = _messages()
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"
    want = C.keep_newest(C.pair_turns(spark.createDataFrame(rows, schema)), ["conv_id", "turn"], 5).collect()
    for part in (rows[:7], rows[7:]):  # the stream is stopped in between and goes on from its checkpoint
        for r in part:
            spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(src / f"m{rows.index(r):02d}"))
        view = _log(spark, src, out, ckpt)
    assert sorted(view.collect()) == sorted(want)
    assert spark.read.parquet(str(out / "log")).count() == 8
    assert sorted(_log(spark, src, out, ckpt).collect()) == sorted(want)  # nothing new


def test_a_batch_run_again_leaves_the_same_log(spark, tmp_path):
    from textsense.operators import chatlog as C
    df = spark.createDataFrame(_messages(), "conv_id long, turn long, role string, text string")
    write = ST.bounded_log_writer(["conv_id", "turn"], 5, C.pair_turns, C.open_turns)
    for _ in range(2):
        write(df, 0, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8
    assert spark.read.parquet(str(tmp_path / "view" / "0")).count() == 5


def test_stream_score_with_a_lexicon_too_large_to_embed(spark, tmp_path, monkeypatch):
    """Terms are looked up in the stored lexicon; the scores are those of the batch form."""
    from textsense.functions import lookup
    from textsense.operators import lexicon as L
    terms = [(f"w{i}", (i % 9 - 4) / 4.0 if i % 3 else None, 1.3, i % 5 == 0, i % 7 == 0) for i in range(60)]
    lx = spark.createDataFrame(terms + terms[:9], L.LEXICON_SCHEMA)
    rows = [(k, " ".join(f"w{(k * j) % 80}" for j in range(k % 13)), "x") for k in range(50)] + [(90, None, "y"), (91, "unknown words", "y")]
    src = tmp_path / "src"
    for j in range(2):
        spark.createDataFrame(rows[j::2], "k long, t string, other string").coalesce(1).write.parquet(str(src / f"b{j}"))
    stream = (spark.readStream.schema("k long, t string, other string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(src)))
    want = {r["k"]: r["polarity"] for r in L.lexicon_polarity(spark.createDataFrame(rows, "k long, t string, other string"), "k", "t", lx).collect()}
    monkeypatch.setattr(lookup, "MAX_LITERAL_ROWS", 10)
    got = ST.run_to_table(ST.stream_score(stream, "t", lx), spark, "test-large-lexicon").collect()
    assert {r["k"]: r["polarity"] for r in got} == want and len(got) == len(rows) and any(want.values())
    assert {r["other"] for r in got} == {"x", "y"}
