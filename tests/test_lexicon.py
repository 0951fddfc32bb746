"""The assessment rules on literal rows; array form = join/window form."""

import pytest
from pyspark.sql import functions as F

from textsense.operators import lexicon as L
from textsense.operators import summary as H

SF_SMALL = "/root/testdata/sf0.001"



ROWS = [("good", 0.7, 1.0, False, False), ("bad", -0.5, 1.0, False, False),
        ("very", 0.2, 1.3, True, False), ("really", None, 1.5, True, False),
        ("not", None, 1.0, False, True), ("tiny", 0.0004, 1.0, False, False)]


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame(ROWS, L.LEXICON_SCHEMA)


@pytest.mark.parametrize("text, polarity, n", [
    ("good", 0.7, 1),
    ("very good", 0.91, 1),                 # modifier joins the word: clamp(0.7 * 1.3)
    ("not good", -0.35, 1),                 # negation: * -0.5
    ("not very good", -0.269, 1),           # clamp(0.7 / 1.3) * -0.5
    ("really good", 1.0, 1),                # clamp(0.7 * 1.5) = 1
    ("very", 0.2, 1),                       # modifier with a polarity, alone
    ("really", 0.0, 0),                     # modifier without polarity: nothing scored
    ("good bad", 0.1, 2),                   # mean
    ("tiny", 0.0, 1),                       # 0.0004 rounds to 0.0 before the sign
    ("", 0.0, 0),
    (None, 0.0, 0),
    ("very very good", 0.91, 1),            # a chain collapses into one assessment
])
def test_rules(spark, lex, text, polarity, n):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    r = L.lexicon_polarity(df, "k", "t", lex).first()
    assert r["polarity"] == pytest.approx(polarity) and r["n"] == n


def test_sign_on_rounded_score(spark, lex):
    df = spark.createDataFrame([(1, "tiny")], "k long, t string")
    assert L.lexicon_sentiment(df, "k", "t", lex).first()["sentiment"] == "neutral"


def test_array_form_equals_window_form(spark):
    from textsense.plans.fixtures import lexicon_df
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a = L.lexicon_polarity(d, "doc_id", "text", lexicon_df(spark)).withColumn("n", F.col("n").cast("int"))
    b = L.lexicon_polarity_exploded(d, "doc_id", "text", lexicon_df(spark))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bulk_score_keeps_rows_and_columns(spark, lex):
    df = spark.createDataFrame([(1, "good", "x"), (2, None, "y")], "k long, t string, other string")
    out = L.bulk_score(df, "t", "lexicon", lexicon=lex)
    assert out.columns == ["k", "t", "other", "Sentiment", "Polarity_Score"]
    rows = {r["k"]: r for r in out.collect()}
    assert rows[1]["Sentiment"] == "Positive 😊" and rows[2]["Sentiment"] == "Neutral 😐"
    assert rows[2]["Polarity_Score"] == 0.0


def test_summary(spark):
    df = spark.createDataFrame([("positive", 0.5), ("positive", 0.25), ("negative", -0.1)], "sentiment string, polarity double")
    got = {r["sentiment"]: (r["n_rows"], r["mean_score"]) for r in H.sentiment_summary(df).collect()}
    assert got == {"positive": (2, 0.375), "negative": (1, -0.1), "ALL": (3, 0.217)}


def test_large_lexicon_gives_the_same_scores(spark):
    """250,000 terms go through the join; the same terms that matter, embedded, score alike."""
    known = "case when id % 3 = 0 then 'good' || id when id % 3 = 1 then 'not' || id else 'very' || id end"
    big = spark.range(250_000).selectExpr(f"{known} term", "case when id % 3 = 0 then (id % 7 - 3) / 4.0 end polarity",
                                          "1.3d intensity", "id % 3 = 2 is_modifier", "id % 3 = 1 is_negation")
    texts = [(k, " ".join(f"{w}{i + k}" for i in range(0, 60, 3) for w in ("not", "very", "good"))) for k in range(40)]
    texts += [(100, None), (101, ""), (102, "not1 very2 good3 good6 very5 very8 good9 not4 good12")]
    df = spark.createDataFrame(texts, "k long, t string")
    used = {w for _, t in texts for w in (t or "").split()}
    few = big.where(big["term"].isin(sorted(used)))
    a = L.lexicon_polarity(df, "k", "t", big).collect()
    b = L.lexicon_polarity(df, "k", "t", few).collect()
    c = L.lexicon_polarity_exploded(df, "k", "t", big).collect()
    assert sorted(a) == sorted(b) and {(r["k"], r["polarity"], r["n"]) for r in a} == {(r["k"], r["polarity"], r["n"]) for r in c}
    assert any(r["polarity"] for r in a)


def test_lexicon_size_is_checked(spark, monkeypatch):
    from textsense.functions import lookup
    big = spark.range(50).selectExpr("cast(id as string) term", "cast(0.1 as double) polarity", "1.0d intensity",
                                     "false is_modifier", "false is_negation")
    with pytest.raises(ValueError):
        lookup.LookupTable(big, "term", ["polarity"], max_rows=10)


REPEATED = [("good", 0.5, 1.0, False, False), ("good", -0.5, 1.0, False, False), ("good", None, 2.0, True, True),
            ("very", None, 1.2, True, False), ("very", None, 1.5, True, False), (None, 1.0, 1.0, False, False)]


def test_repeated_terms_mean_the_same_in_all_ways(spark):
    lx = spark.createDataFrame(REPEATED, L.LEXICON_SCHEMA).repartition(4)
    df = spark.createDataFrame([(1, "good"), (2, "very good"), (3, "good very"), (4, None)], "k long, t string")
    want = {1: (0.5, 1), 2: (0.75, 1), 3: (0.5, 1), 4: (0.0, 0)}
    from textsense.functions import text as T
    for max_rows in (None, 1):  # embedded, joined
        looked = L.with_looked_up(df, T.index_tokens("t"), lx, "lk", max_rows).withColumn("acc", L.polarity_of_looked("lk"))
        got = {r["k"]: (r["p"], r["n"]) for r in looked.select("k", L.polarity_from_sum("acc").alias("p"), "acc.n").collect()}
        assert got == want
    assert {r["k"]: (r["polarity"], r["n"]) for r in L.lexicon_polarity_exploded(df, "k", "t", lx).collect()} == want
