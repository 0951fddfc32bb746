"""SURVEY §5 properties: score range, ML features = TF-IDF formula, stream restart from
checkpoint carries the limiter state."""

import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F


from textsense.operators import classify as CL
from textsense.operators import lexicon as L
from textsense.plans.fixtures import lexicon_df
from textsense.streaming import streams as ST

SF_SMALL = "/root/testdata/sf0.001"


def test_polarity_in_range(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    r = L.lexicon_polarity(d, "doc_id", "text", lexicon_df(spark)).agg(
        F.min("polarity").alias("lo"), F.max("polarity").alias("hi"), F.count("*").alias("n")).first()
    assert -1.0 <= r["lo"] <= r["hi"] <= 1.0 and r["n"] == d.count()


def test_ml_features_equal_tfidf_formula(spark):
    rows = [(1, "good good day", "positive"), (2, "bad day", "negative"), (3, "good night", "positive"),
            (4, "bad bad bad night", "negative")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = CL.train_classifier(df, "text", "label")
    cv, scale = model.pipeline.stages[1], model.pipeline.stages[2]
    vocab, idf = cv.vocabulary, list(scale.getScalingVec())
    feats = model.pipeline.stages[0:4]
    from pyspark.ml import PipelineModel
    prep = PipelineModel(stages=feats)
    out = prep.transform(CL.features_tokens(df, "text")).select("id", CL.FEATURE_TOKENS,
                                                                vector_to_array("features").alias("v"))
    n = len(rows)
    toks = {r["id"]: r[CL.FEATURE_TOKENS] for r in out.collect()}
    dfreq = Counter(t for ts in toks.values() for t in set(ts))
    for t, w in zip(vocab, idf):
        assert w == pytest.approx(math.log((1 + n) / (1 + dfreq[t])) + 1)
    for r in out.collect():
        c = Counter(r[CL.FEATURE_TOKENS])
        raw = [c[t] * w for t, w in zip(vocab, idf)]
        norm = math.sqrt(sum(x * x for x in raw))
        assert list(r["v"]) == pytest.approx([x / norm for x in raw])


def test_stream_limiter_restarts_from_checkpoint(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "id long, user long, ts timestamp"
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"

    def add(name, rows):
        spark.createDataFrame([(i, u, t0 + dt.timedelta(seconds=s)) for i, u, s in rows], schema) \
             .coalesce(1).write.parquet(str(src / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
        q = (ST.stream_rate_limit(stream, "user", "ts", "id", max_n=2, window_s=60)
             .writeStream.option("checkpointLocation", str(ckpt)).trigger(availableNow=True)
             .format("parquet").option("path", str(out)).start())
        q.awaitTermination()

    add("a", [(0, 1, 0), (1, 1, 10), (2, 2, 15)])
    run()
    add("b", [(3, 1, 20), (4, 1, 71), (5, 2, 16), (6, 2, 17)])   # user 1 at 20 s: log still full
    run()                                                        # a restarted query, same checkpoint
    got = {r["id"]: r["admitted"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
