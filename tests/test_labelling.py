"""D8 with saved progress and U1 with one set-up a worker, scorer calls counted."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from textsense.operators import classify as CL


def counting_scorer(folder, fail_on=None):
    """Labels by the text's length; notes every row it is given, and fails on the row ``fail_on``."""
    def fn(s):
        if fail_on is not None and (s == fail_on).any():
            raise RuntimeError("scorer stopped")
        for t in s:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(t or "")
        return s.str.len().mod(2).map({0: "positive", 1: "negative"})
    return CL.pandas_scorer(fn)


def scored(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


def test_a_run_killed_midway_labels_only_the_rest(spark, tmp_path):
    rows = [(i, f"text {'x' * (i % 5)} {i}", i * 2) for i in range(60)] + [(None, "no key", 0), (7, "text of a key that comes twice", 1)]
    df = spark.createDataFrame(rows, "k long, t string, other long").repartition(3)
    calls, path = tmp_path / "calls", str(tmp_path / "out")
    calls.mkdir()
    step = {r["k"]: r["s"] for r in df.select("k", F.pmod(F.xxhash64("k"), F.lit(6)).alias("s")).collect()}
    stop = next(r for r in rows if step[r[0]] == 3)  # the fourth of six steps fails
    with pytest.raises(Exception, match="scorer stopped"):
        CL.label_saving_progress(df, "k", "t", counting_scorer(str(calls), stop[1]), path, steps=6)
    first = [t for t in scored(calls) if step[next(r[0] for r in rows if r[1] == t)] < 3]
    saved = sorted(r[1] for r in rows if step[r[0]] < 3)
    assert first == saved and 0 < len(saved) < len(rows)
    for f in calls.iterdir():
        f.write_text("")
    before = len(list(calls.iterdir()))
    got = CL.label_saving_progress(df, "k", "t", counting_scorer(str(calls)), path, steps=6)
    assert sorted(t for t in scored(calls) if t) == sorted(r[1] for r in rows if step[r[0]] >= 3)
    assert len(list(calls.iterdir())) - before == len(rows) - len(saved)
    want = sorted([(*r, "positive" if len(r[1]) % 2 == 0 else "negative") for r in rows], key=str)
    assert got.columns == ["k", "t", "other", "sentiment"] and sorted(map(tuple, got.collect()), key=str) == want
    again = CL.label_saving_progress(df, "k", "t", counting_scorer(str(calls)), path, steps=6)  # nothing is left to do
    assert again.count() == len(rows) and len(list(calls.iterdir())) - before == len(rows) - len(saved)


def test_progress_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "k long, t string")
    got = CL.label_saving_progress(df, "k", "t", CL.pandas_scorer(lambda s: s), str(tmp_path / "o"), steps=2)
    assert got.columns == ["k", "t", "sentiment"] and got.count() == 0


def test_one_set_up_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            return {0: "Positive", 1: "other"}
    scorer = CL.loaded_scorer(load, lambda model, s: s.str.len().mod(2).map(model), f"parity-{uuid.uuid4().hex}")
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(400)], "k long, t string").repartition(20)
    for _ in range(2):  # 40 tasks in all
        got = CL.label_with(df, "t", scorer).collect()
        assert {(len(r["t"]) % 2 == 0) == (r["sentiment"] == "positive") for r in got} == {True} and len(got) == 400
    workers = [n.split("-")[0] for n in os.listdir(folder)]
    assert len(workers) == len(set(workers)) < 40
