import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsense.llm import conv_toxicity as C
from textsense.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
TEXTS = ["One two, idiot three!", "", None, " ... ", "é日本 ÉÉ x9", "a " * 40, "b c d e f"]


def net():
    out = C.Net.fresh(0.2)
    rng = np.random.default_rng(3)
    out.tables = [np.vstack([rng.normal(0, 1, (C._PAD, C.DIM)), np.zeros((1, C.DIM))]).astype(np.float32) for _ in range(2)]
    out.bias = rng.normal(0, 0.1, len(out.bias)).astype(np.float32)
    return out


def brute_logit(n, text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    ids = [C.word_buckets([w])[0][:, 0] for w in words]
    x = np.array([n.tables[0][a] + n.tables[1][b] for a, b in ids] + [np.zeros(C.DIM)] * (2 + (not ids)))
    top = [max(sum(x[t + j] @ f[j, :, c] for j in range(w)) for t in range(max(len(ids), 1))) for w, f in zip(C.WIDTHS, n.filters) for c in range(C.FILTERS)]
    return np.maximum(np.array(top) + n.bias, 0) @ n.out[:-1] + n.out[-1]


def test_logits_equal_brute_force_in_blocks(monkeypatch):
    n = net()
    whole = n.logits(TEXTS)
    assert np.allclose(whole, [brute_logit(n, t) for t in TEXTS], atol=1e-3)
    monkeypatch.setattr(C, "BLOCK", 5)
    assert np.allclose(n.logits(TEXTS), whole, atol=1e-4) and n.logits([]).shape == (0,)
    assert len(set(np.round(n.logits(["", None, " ... "]), 6))) == 1


def test_buckets_share_stems():
    a, b, c = (C.word_buckets([w])[0][:, 0] for w in ("spelling", "Spelled", "spend"))
    assert a[1] == b[1] != c[1] and a[0] != b[0]


def test_a_step_follows_the_gradient():
    texts, y = ["bad words here", "good words there", "bad again", "fine"], np.array([1, 0, 1, 0], dtype=np.float32)
    b, cuts = C.word_buckets(texts)

    def loss(n):
        p = C.sigmoid(n.logits(texts))
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))
    n = net()
    for i in range(len(n.arrays())):
        before, after = net(), net()
        after.learn([(b, cuts, y)], 1e-3)
        mixed = C.Net.of([y if j == i else x for j, (x, y) in enumerate(zip(before.arrays(), after.arrays()))])
        d = (mixed.arrays()[i] - before.arrays()[i]).astype(np.float64)
        assert np.abs(d).max() > 0 and loss(mixed) < loss(before), i
    start = loss(n)
    for _ in range(30):
        n.learn([(b, cuts, y)], 0.05)
    assert loss(n) < start / 2 and not n.tables[0][C._PAD].any() and not n.tables[1][C._PAD].any()


def test_best_middle():
    assert C._best_middle([(0, 5, 0), (9, 5, 5)]) == 5.0          # between bin 0's end and 9
    assert C._best_middle([(0, 5, 0), (1, 2, 1), (5, 9, 9)]) in (1.0, 3.5)


def test_held_out_accuracy(spark):
    """The label is learnt: rows that the fit has not seen are told apart."""
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op12_conv_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    y, p = np.array([toxic[r["doc_id"]] for r in held]), np.array([r["predicted"] for r in held])
    assert (y == p).mean() > 0.97 and p[y == 0].mean() < 0.01 and p[y == 1].mean() > 0.8


@pytest.fixture
def labelled(spark):
    rows = [(i, f"some plain text number {i} with {'vile words' if i % 4 == 0 else 'kind words'} inside", "en" if i % 3 else "de") for i in range(400)]
    docs = spark.createDataFrame([(i, t, a, 1, "x") for i, t, a in rows], "doc_id bigint, text string, lang string, y int, k string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "id bigint, bad int")
    return docs, labels


def test_columns_edges_and_thresholds(spark, labelled, texts, edge_rows):
    docs, labels = labelled
    odd = labels.union(spark.createDataFrame([(3, None), (5, 7), (None, 1), (9999, 1), (0, 0), (0, 1)], "id bigint, bad int"))
    model, levels = C.fit(docs.union(docs.limit(3)), "doc_id", "text", odd, "id", "bad", "lang", rounds=3)
    got = C.score(docs, "text", model, "p").collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "y", "k", "p"}
    assert np.mean([(r["p"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got]) > 0.98
    edge = C.score(texts(edge_rows), "text", model, "label").collect()   # replaces the input's column of that name
    assert len(edge) == len(edge_rows) and all(0 <= r["label"] <= 1 for r in edge)
    assert edge[0]["label"] == edge[1]["label"] == edge[2]["label"]       # null, empty and blank
    flags = C.flag(C.score(docs, "text", model, "p"), "p", "lang",
                   spark.createDataFrame([("de", 2.0)], "lang string, threshold double")).collect()
    assert not any(r["flagged"] for r in flags if r["lang"] == "de") and any(r["flagged"] for r in flags)
    assert levels.columns == ["lang", "threshold"]


def test_labels_without_both_classes(spark, labelled):
    docs, labels = labelled
    for some, want in ((labels.where("bad = 1"), 1.0), (labels.where("bad = 0"), 0.0), (labels.limit(0), 0.5)):
        model, _ = C.fit(docs, "doc_id", "text", some, "id", "bad")
        assert {r["score"] for r in C.score(docs, "text", model).collect()} == {want}
    model, _ = C.fit(docs.limit(0), "doc_id", "text", labels, "id", "bad", learn=F.col("id") > 5)
    assert model.constant == 0.5 and C.score(docs.limit(0), "text", model).collect() == []


def test_the_sample_is_bounded(spark, labelled):
    docs, labels = labelled
    many = docs.union(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    model, _ = C.fit(many, "doc_id", "text", labels, "id", "bad", max_train=60, rounds=1)
    assert model.net is not None
