"""Toxicity learns from every labelled row, and its parameters are averaged in bounded steps."""

import numpy as np
import pytest

from textsense.llm import conv_toxicity as C


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    seen = []
    calibrated = C._calibrated
    monkeypatch.setattr(C, "_calibrated", lambda rows, net: seen.append(rows.count()) or calibrated(rows, net))
    n = 40_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat(if(id % 4 = 0, 'vile ', 'kind '), id) as text")
    labels = spark.range(n).selectExpr("id", "cast(id % 4 = 0 as int) as bad")
    model, _ = C.fit(docs, "doc_id", "text", labels, "id", "bad", rounds=1)
    assert abs(seen[0] - n / C.CALIBRATE) < n / 50      # the rows kept out to calibrate are a fifth of all
    got = C.score(docs.limit(400), "text", model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got]) > 0.98


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_means_of_many_tasks(spark, parts, monkeypatch):
    monkeypatch.setattr(C, "FAN", 3)
    net = C.Net.fresh(0.5)

    def made(batches):
        from pyspark import TaskContext
        for _ in batches:
            pass
        at = TaskContext.get().partitionId()
        yield C._sent(at + 1, [np.full(x.shape, at, dtype=np.float32) for x in C.Net.fresh(0.5).arrays()])
    sent = C._added(spark.range(parts, numPartitions=parts).mapInArrow(made, C._SENT), parts, net).toArrow()
    mean, weight = C._mean(sent, net)
    assert sent.num_rows <= 3 and weight == parts * (parts + 1) // 2
    want = sum(i * (i + 1) for i in range(parts)) / weight
    assert all(np.allclose(m, want, rtol=1e-5) for m in mean)


def test_no_text_is_stored_and_unlabelled_ones_are_not_dealt_out(spark, monkeypatch):
    """Only the words of texts with a label, two bytes a bucket, go through the join and to disk."""
    kept = {}
    stored = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    docs = spark.range(4000).selectExpr("id as doc_id", "concat(if(id % 4 = 0, 'vile ', 'kind '), repeat('words ', 50)) as text")
    labels = spark.range(0, 4000, 10).selectExpr("id", "cast(id % 4 = 0 as int) as bad")
    C.fit(docs, "doc_id", "text", labels, "id", "bad", rounds=1)
    for name in ("training-rows", "training-words"):
        assert "t" not in kept[name].columns
        assert {len(r["b"]) for r in kept[name].select("b").collect()} == {51 * 2 * 2}
    assert kept["training-rows"].count() == 400


def test_chunks_are_learnt_one_by_one_and_cut_nowhere_else():
    import pyarrow as pa
    rows = [(0, b"a", 1)] * 20 + [(3, b"b", 0)] * 5 + [(4, b"c", 1)] * 16
    for size in (1, 7, 41):
        batches = [pa.RecordBatch.from_pylist([dict(zip("cby", r)) for r in rows[a:a + size]]) for a in range(0, len(rows), size)]
        got = [(c, len(x)) for c, x in C._by_chunk(batches)]
        assert got == [(0, 16), (0, 4), (3, 5), (4, 16)]


def test_one_task_learns_many_chunks(spark, monkeypatch):
    """The sets that are sent on grow with the rows by FAN chunks, and every row is learnt from."""
    sent = []
    added = C._added
    monkeypatch.setattr(C, "_added", lambda df, parts, like: sent.append(df.toArrow()) or added(df, parts, like))
    monkeypatch.setattr(C, "TRAIN_ROWS", 10)
    docs = spark.range(3000).selectExpr("id as doc_id", "concat(if(id % 4 = 0, 'vile ', 'kind '), id) as text")
    labels = spark.range(3000).selectExpr("id", "cast(id % 4 = 0 as int) as bad")
    model, _ = C.fit(docs, "doc_id", "text", labels, "id", "bad", rounds=2)
    tasks = max(-(-300 // C.FAN), spark.sparkContext.defaultParallelism)
    assert all(x.num_rows <= tasks and abs(sum(x["n"].to_pylist()) - 2400) < 120 for x in sent) and len(sent) == 2
    assert model.net is not None
