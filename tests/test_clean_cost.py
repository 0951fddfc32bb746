"""Cleaning costs: the spelled-out ranges of C4 are its negated class, and a text is stemmed once
on its way into a stored table."""

from pyspark.sql import functions as F

from textsense import session
from textsense.functions import text as T
from textsense.operators import classify as CL
from textsense.plans import model_queries as M

ROWS = [(i, f"Running words{'abc'[i % 3]} number {i} nicely" if i % 5 else "12 #!", "en", "s", 9) for i in range(60)]


def test_ranges_are_the_negated_class(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [("".join(every[a:a + 4096]),) for a in range(0, len(every), 4096)]
    df = spark.createDataFrame(texts, "t string")
    got = df.select(T.letters_only("t").alias("a"), F.regexp_replace("t", T.NON_LETTER_PATTERN, "").alias("b"))
    assert got.where("a <> b").count() == 0
    assert "[^A-Za-z" not in str(T.letters_only("t")._jc.toString())
    kept = "".join(r["a"] for r in got.collect())
    assert sorted(c for c in kept if c.isascii() and c.isalpha()) == sorted(c for c in every if c.isascii() and c.isalpha())
    assert len(kept) == 52 + 29  # the letters and the blanks of Python


def _stem_steps(monkeypatch, module, run):
    steps, stored = {}, session.stored

    def spy(df, name):
        steps[name] = df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        return stored(df, name)
    monkeypatch.setattr(module, "stored", spy)
    out = run()
    return steps, out


def test_train_tokens_are_stemmed_once(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    labelled = docs.withColumn("label", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    steps, model = _stem_steps(monkeypatch, session, lambda: CL.train_classifier(labelled, "text", "label"))
    assert steps["train-tokens"] == 1
    assert CL.predict(model, docs).count() == 60


def test_step_counts_stem_once(spark, monkeypatch, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    steps, out = _stem_steps(monkeypatch, M, lambda: M.step_counts_stemmed(spark, str(tmp_path)).collect())
    assert steps["stemmed"] == 1
    assert out[0]["cleaned"] == 48 and out[0]["loaded"] == 60
