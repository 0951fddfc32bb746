"""Train, predict, empty guard, save/load."""

import pytest

from textsense.operators import classify as CL

POS = ["great wonderful happy day", "love this wonderful thing", "happy happy joy", "wonderful great love"]
NEG = ["terrible awful sad day", "hate this awful thing", "sad angry bad", "awful terrible hate"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, "positive") for i, t in enumerate(POS)] + [(10 + i, t, "negative") for i, t in enumerate(NEG)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    return CL.train_classifier(df, "text", "label")


def test_predicts_training_classes(spark, model):
    df = spark.createDataFrame([(1, "wonderful love"), (2, "awful hate")], "id long, text string")
    got = {r["id"]: r for r in CL.predict(model, df).collect()}
    assert got[1]["prediction_label"] == "positive" and got[2]["prediction_label"] == "negative"
    assert 0.5 < got[1]["confidence"] <= 1.0


def test_empty_guard_and_columns(spark, model):
    df = spark.createDataFrame([(1, "http://x.y @bob 123"), (2, None), (3, "great")], "id long, text string")
    out = CL.model_sentiment(df, "text", model)
    assert out.columns == ["id", "text", "Sentiment", "Confidence"]
    got = {r["id"]: (r["Sentiment"], r["Confidence"]) for r in out.collect()}
    assert got[1] == ("Neutral 😐", 0.0) and got[2] == ("Neutral 😐", 0.0)
    assert got[3][0] == "Positive 😊"


def test_save_load_same_predictions(spark, model, tmp_path):
    path = str(tmp_path / "m")
    model.save(path)
    back = CL.TextModel.load(path, "text")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(POS + NEG + ["unknown words only"])], "id long, text string")
    a = sorted((r["id"], r["prediction_label"], round(r["confidence"], 9)) for r in CL.predict(model, df).collect())
    b = sorted((r["id"], r["prediction_label"], round(r["confidence"], 9)) for r in CL.predict(back, df).collect())
    assert a == b
    with pytest.raises(FileNotFoundError):
        CL.TextModel.load(str(tmp_path / "nope"))


def test_a_vocabulary_too_large_to_embed_trains_alike(spark, model, monkeypatch):
    from textsense.operators import vocab as V
    rows = [(i, t, "positive") for i, t in enumerate(POS)] + [(10 + i, t, "negative") for i, t in enumerate(NEG)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    monkeypatch.setattr(V, "MAX_LITERAL_ROWS", 3)
    other = CL.train_classifier(df, "text", "label", max_terms=None)
    a, b = (sorted((r["id"], r["prediction_label"], round(r["confidence"], 6)) for r in CL.predict(m, df).collect()) for m in (model, other))
    assert a == b
