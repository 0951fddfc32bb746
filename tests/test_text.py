"""The literal rows of FIXTURES §3 and a few more."""

import pytest
from pyspark.sql import functions as F

from textsense.functions import text as T


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw, expected", [
    (None, ""),
    ("@bob #!! 123 http://a.b", ""),
    ("awww.z ok", "a ok"),
    ("HTTP://x.y", "httpxy"),
    ("don't", "dont"),
    ("été", "t"),
    ("#Vote now", "vote now"),
])
def test_normalise_fixture_rows(spark, raw, expected):
    """FIXTURES §3: values after C1-C5 and trimming."""
    assert one(spark, T.strip_ws(T.normalise("x")), raw) == expected


@pytest.mark.parametrize("raw, expected", [
    (None, ""),
    ("awww.z ok", "ok"),
    ("don't stop", "dont stop"),
    ("Hello @user_1, visit https://x.io/y?z=1 NOW!!", "hello visit"),  # "now" is a stop word
    ("tab\tand\nnew line", "tab new line"),
])
def test_clean_text(spark, raw, expected):
    assert one(spark, T.clean_text("x"), raw) == expected


def test_stop_words_keep_order_and_duplicates(spark):
    assert one(spark, T.clean_text("x"), "the cat and THE cat sat") == "cat cat sat"


def test_stop_list_is_the_published_one():
    assert len(T.STOP_WORDS) == 179 and "dont" not in T.STOP_WORDS and "don't" in T.STOP_WORDS


def test_mentions_use_unicode_word_chars(spark):
    assert one(spark, T.strip_mentions("x"), "hi @José! ok") == "hi ! ok"


def test_index_tokens_drop_single_chars_and_split_punctuation(spark):
    assert one(spark, T.index_tokens("x"), "A b-cd, Éte_x 9 42!") == ["cd", "éte_x", "42"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(T.ngrams(F.col("t"))).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_ngram_trigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert df.select(T.ngrams(F.col("t"), 1, 3)).first()[0] == ["a", "b", "c", "a b", "b c", "a b c"]


@pytest.mark.parametrize("raw, expected", [(None, []), ("[]", []), ('["a"]', ["a"]), ("", [])])
def test_parse_sources(spark, raw, expected):
    assert one(spark, T.parse_sources("x"), raw) == expected


def test_sources_json_roundtrip(spark):
    df = spark.createDataFrame([(["a", "é b"],), (None,)], "s array<string>")
    got = [r[0] for r in df.select(T.parse_sources(T.sources_json("s"))).collect()]
    assert got == [["a", "é b"], []]


def test_strip_and_blank(spark):
    assert one(spark, T.strip_ws("x"), "\n  hi \t") == "hi"
    assert one(spark, T.non_blank("x"), " \n ") is False
    assert one(spark, T.non_blank("x"), None) is False


def test_prefix_counts_code_points(spark):
    assert one(spark, T.prefix("x", 3), "éàü€x") == "éàü"


def test_title_default(spark):
    assert one(spark, T.title_or_default("x"), None) == "Untitled Source"
    assert one(spark, T.title_or_default("x"), "") == "Untitled Source"
    assert one(spark, T.title_or_default("x"), "T") == "T"


def test_round3_before_sign(spark):
    df = spark.createDataFrame([(0.0004,), (-0.0004,), (0.0006,)], "s double")
    got = df.select(T.sign_label(T.round3("s")).alias("l")).collect()
    assert [r["l"] for r in got] == ["neutral", "neutral", "positive"]


def test_display_label(spark):
    df = spark.createDataFrame([("positive",), ("NEGATIVE",), ("other",), (None,)], "l string")
    got = [r[0] for r in df.select(T.display_label("l")).collect()]
    assert got == ["Positive 😊", "Negative 😠", "Neutral 😐", "Neutral 😐"]


def test_display_prediction_v1(spark):
    df = spark.createDataFrame([("positive", 0.876), ("weird", 0.5)], "l string, c double")
    got = [r[0] for r in df.select(T.display_prediction_v1("l", "c")).collect()]
    assert got == ["😊 Predicted Sentiment: POSITIVE (Confidence: 0.88)",
                   "❓ Predicted Label: weird (Confidence: 0.50)"]
