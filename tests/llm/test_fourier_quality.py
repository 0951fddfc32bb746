import numpy as np

from textsense.llm import fourier_quality as Q
from textsense.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(Q.STATS)))
    z = Q.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.BANDWIDTH ** 2))
    assert np.abs(z @ z.T - want).max() < 0.3 and np.abs(z @ z.T - want).mean() < 0.06


def test_isotonic():
    knots, levels = Q.isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 9, 10.0]), np.full(6, 10.0))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    assert np.allclose(levels, [0, 0.2, 0.9, 1.0]) and np.allclose(knots, [0, 2, 4, 5])


def test_held_out_accuracy(spark):
    import zlib
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op6_fourier_quality"](spark, SF).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_edges(spark, texts, edge_rows):
    df = texts(edge_rows)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, q int")
    for rows, want in (([], 0.5), ([(4, 1), (7, 1)], 1.0), ([(5, 0), (77, 1), (None, 1), (1, None)], 0.0)):
        model, stats = Q.fit(df, "doc_id", "text", labels(rows), "doc_id", "q")
        assert model.constant == want
        assert [r["s"] for r in Q.score(stats, "stats", model, "s").collect()] == [want] * len(edge_rows)
    model, stats = Q.fit(df, "doc_id", "text", labels([(1, 0), (2, 0), (4, 1), (5, 0), (7, 1)]), "doc_id", "q")
    assert all(0 <= r["s"] <= 1 for r in Q.score(stats, "stats", model, "s").collect())
    kept = Q.keep_good(df, "doc_id", "text", labels([(4, 1)]), "doc_id", "q")
    assert kept.columns == df.columns and kept.count() == len(edge_rows)
    assert Q.keep_good(texts([]), "doc_id", "text", labels([]), "doc_id", "q").count() == 0
    assert Q.statistics(None) == Q.statistics("") == [0.0] * len(Q.STATS)
