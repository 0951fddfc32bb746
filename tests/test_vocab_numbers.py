"""Vocabulary and weights counted by number equal those of all terms; pairs that cannot be in the
vocabulary are not counted."""

import random

from pyspark.sql import functions as F

from textsense.functions import text as T
from textsense.operators import vocab as V


def _docs(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["été", "naïve", "日本", "mañana"]
    rows = [(i % 190, " ".join(rnd.choices(words, weights=range(len(words), 0, -1), k=rnd.randrange(30)))) for i in range(200)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (None, "w1 w2 w1 w2")], "id long, t string").repartition(3)


def _plain(docs, max_terms, ngram):
    counts = V.term_counts(docs.withColumn("row", F.monotonically_increasing_id()), "row", "t", ngram)
    return V.build_vocab(counts, docs.count(), max_terms)


def test_equal_to_counting_every_term(spark, monkeypatch):
    docs = _docs(spark)
    for slice_tokens in (7, 1 << 20):
        monkeypatch.setattr(V, "SLICE_TOKENS", slice_tokens)
        for ngram in ((1, 1), (1, 2)):
            for cap in (5, 70, 10_000):
                voc = V.fit_vocabulary(docs, "id", "t", cap, ngram)
                want = sorted(map(tuple, _plain(docs, cap, ngram).collect()))
                assert sorted(map(tuple, voc.df.select("term", "total_tf", "df", "idf").collect())) == want
                got = V.tfidf(docs, "id", "t", voc, ngram)
                counts = V.doc_terms(docs, "id", "t", ngram)
                plain = voc.with_weights(counts).drop("counts")
                key = lambda r: repr((r["id"], r["norm"], [tuple(x) for x in r["terms"]]))
                assert sorted(map(key, got.collect())) == sorted(map(key, plain.select("id", "terms", "norm").collect()))


def test_rare_pairs_are_not_counted(spark):
    """Every pair is new, two words are frequent: only their totals are looked for."""
    docs = spark.createDataFrame([(i, f"aa bb x{i} y{i}") for i in range(300)], "id long, t string")
    toks = docs.select(T.index_tokens("t").alias("tok"))
    totals = V.top_totals(toks, "tok", 2)
    assert sorted(map(tuple, totals.collect())) == [("aa", 300, 300), ("aa bb", 300, 300), ("bb", 300, 300)]
    voc = V.fit_vocabulary(docs, "id", "t", 2)
    assert sorted(r["term"] for r in voc.df.collect()) == ["aa", "aa bb"]


def test_too_many_ties_count_all_terms(spark, monkeypatch):
    docs = _docs(spark)
    want = sorted(map(tuple, _plain(docs, 30, (1, 2)).collect()))
    monkeypatch.setattr(V, "few_rows", lambda df, limit=10: None if "idf" not in df.columns else df.collect())
    voc = V.fit_vocabulary(docs, "id", "t", 30)
    assert sorted(map(tuple, voc.df.select("term", "total_tf", "df", "idf").collect())) == want
