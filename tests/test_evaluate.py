"""E6, E9-E12, B6, B7 and D7/D8 labelling."""

import pytest
from pyspark.sql import functions as F

from textsense.operators import classify as CL
from textsense.operators import evaluate as EV
from textsense.operators import filters as FI


def test_stratified_split_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    s = EV.stratified_split(df, "k", "y", 0.2, 42)
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    n1 = 143
    assert counts[(1, "test")] == round(0.2 * n1) and counts[(0, "test")] == round(0.2 * (1000 - n1))
    s2 = EV.stratified_split(df, "k", "y", 0.2, 42)
    assert s.exceptAll(s2).count() == 0


def test_report_identities(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "c")]
    df = spark.createDataFrame(rows, "y string, p string")
    rep = {r["row_name"]: r for r in EV.class_report(df, "y", "p").collect()}
    assert set(rep) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert rep["a"]["precision"] == 1.0 and rep["a"]["recall"] == pytest.approx(5 / 7)
    assert rep["c"]["precision"] == 0.0 and rep["c"]["support"] == 0 and rep["c"]["f1"] == 0.0
    assert rep["accuracy"]["f1"] == pytest.approx(8 / 11) and rep["accuracy"]["support"] == 11
    for c in "ab":
        pred = sum(1 for _, p in rows if p == c)
        assert rep[c]["precision"] * pred == pytest.approx(rep[c]["recall"] * rep[c]["support"])
    conf = {(r["true"], r["pred"]): r["n"] for r in EV.confusion(df, "y", "p").collect()}
    assert len(conf) == 9 and conf[("a", "b")] == 2 and conf[("c", "a")] == 0
    assert EV.accuracy(df, "y", "p").first()["accuracy"] == pytest.approx(8 / 11)


def test_sample_and_head(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert FI.sample_n(df, "k", 100).count() == 50
    s = [r["k"] for r in FI.sample_n(df, "k", 10, 42).collect()]
    assert s == [r["k"] for r in FI.sample_n(df, "k", 10, 42).collect()] and len(set(s)) == 10
    assert [r["k"] for r in FI.head_by(df, "k", 3).collect()] == [0, 1, 2]


def test_resume_twice_equals_once(spark):
    from textsense.plans.fixtures import lexicon_df
    docs = spark.createDataFrame([(1, "rewh rewh"), (2, "hehely"), (3, "nothing")], "doc_id long, text string")
    done = spark.createDataFrame([(2, "positive")], "doc_id long, sentiment string")
    scorer = CL.lexicon_scorer(lexicon_df(spark))
    once = CL.label_remaining(docs, done, "doc_id", "text", scorer)
    twice = CL.label_remaining(docs, once, "doc_id", "text", scorer)
    got = {r["doc_id"]: r["sentiment"] for r in twice.collect()}
    assert got == {1: "positive", 2: "positive", 3: "negative"} and twice.count() == 3


def test_pandas_scorer(spark):
    docs = spark.createDataFrame([(1, "x" * 600)], "doc_id long, text string")
    scorer = CL.pandas_scorer(lambda s: s.str.len().map(lambda n: "POSITIVE" if n == 512 else "NEGATIVE"))
    assert CL.label_with(docs, "text", scorer).first()["sentiment"] == "positive"


def _step_tables(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")


def test_step_counts_stemmed_equals_brute_force(spark, tmp_path):
    import hashlib
    import re

    import __spark_entry__ as E
    from textsense.functions.porter import stem

    # "the" and "42" are empty after cleaning; each word comes in three forms with one stem
    words = ["connect", "walk", "jump", "train", "load", "paint", "clean", "report", "count", "test"]
    docs = [(i, f"{words[i % 10]} {words[i % 7]}ing {words[i % 3]}ed " + "x" * (3 + i % 5) + "q") for i in range(40)]
    docs += [(40, "the"), (41, "42"), (42, "")]
    _step_tables(spark, str(tmp_path), docs)
    got = E.queries()["step_counts_stemmed"](spark, str(tmp_path)).collect()[0].asDict()
    kept = [(i, t) for i, t in docs if i < 40]
    order = lambda r: (hashlib.md5(f"{r[0]}:42".encode()).hexdigest(), r[0])
    train = []
    for side in (0, 1):
        rows = sorted([r for r in kept if r[0] % 2 == side], key=order)
        train += rows[round(len(rows) * 0.2):]
    stems = {stem(w) for _, t in train for w in re.findall("[a-z]+", t)}
    assert got == {"loaded": 43, "cleaned": 40, "train": 32, "test": 8, "vocabulary": len(stems)}
    assert len(stems) < len({w for _, t in train for w in t.split()})


def test_step_counts_stemmed_stops_at_the_trainers_cap(spark, tmp_path):
    import __spark_entry__ as E
    from itertools import product
    words = ["".join(p) + "zq" for p in product("bcdfghjklmnpqrtvwx", repeat=3)]  # 5,832, each its own stem
    docs = [(i, " ".join(words)) for i in range(10)]
    _step_tables(spark, str(tmp_path), docs)
    assert E.queries()["step_counts_stemmed"](spark, str(tmp_path)).first()["vocabulary"] == 5000
