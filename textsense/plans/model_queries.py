"""Queries over labelling, splits, evaluation and the trained classifier
(B6, B7, C8, C10, D4-D8, E6-E15, H7, A9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as CL
from ..operators import evaluate as EV
from ..operators import filters as FI
from ..operators import lexicon as L
from ..operators import stem as S
from ..session import shared_path, stored
from .common import table
from .fixtures import lexicon_df
from .sqlparts import clean_text_sql, index_tokens_sql, lexicon_polarity_sql, sign_label_sql, strip_ws_sql

QUERIES = {}
SQL = {}

SEED = 42
TEST = 0.2
SAMPLE_N = 500
HEAD_N = 20


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _label_expr(c):
    return F.when(F.col(c) == 1, "positive").otherwise("negative")


_LABEL_SQL = "CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END"


def _labelled(spark, sf):
    """documents that have a label row, with the class as text."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels", spread_rows=False)
    return d.join(lab, "doc_id").withColumn("label", _label_expr("quality"))


# --- splits and samples -------------------------------------------------------------------

_SPLIT_SQL = f"""split AS (SELECT doc_id, quality,
    CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id)
              <= round(count(*) OVER (PARTITION BY quality) * {TEST}) THEN 'test' ELSE 'train' END AS split
  FROM labels l JOIN documents d USING (doc_id))"""


def _split(rows, label):
    """(doc_id, label, split), stored: only keys and classes go through the split's windows."""
    return stored(EV.stratified_split(rows.select("doc_id", label), "doc_id", label, TEST, SEED), "split")


@register("split_rows", f"WITH {_SPLIT_SQL} SELECT doc_id, quality, split FROM split")
def split_rows(spark, sf):
    return _split(_labelled(spark, sf), "quality").select("doc_id", "quality", "split")


@register("split_counts", f"""WITH {_SPLIT_SQL}
SELECT quality, split, CAST(count(*) AS BIGINT) AS n FROM split GROUP BY quality, split""")
def split_counts(spark, sf):
    s = _split(_labelled(spark, sf), "quality")
    return s.groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n"))


@register("sample_rows", f"""
(SELECT 'sample' AS kind, doc_id, n_chars FROM documents
 ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id LIMIT {SAMPLE_N})
UNION ALL
(SELECT 'head' AS kind, doc_id, n_chars FROM documents ORDER BY doc_id LIMIT {HEAD_N})""")
def sample_rows(spark, sf):
    """B7 (seeded sample of min(500, N) rows) and B6 (first 20 in key order)."""
    d = table(spark, sf, "documents", spread_rows=False).select("doc_id", "n_chars")
    s = FI.sample_n(d, "doc_id", SAMPLE_N, SEED).select(F.lit("sample").alias("kind"), "doc_id", "n_chars")
    h = FI.head_by(d, "doc_id", HEAD_N).select(F.lit("head").alias("kind"), "doc_id", "n_chars")
    return s.unionByName(h)


# --- evaluation of the lexicon engine against the quality labels ---------------------------

_EVAL_SQL = f"""pol AS {lexicon_polarity_sql('documents', 'doc_id', 'text')},
ev AS (SELECT l.doc_id, {_LABEL_SQL} AS y, {sign_label_sql('pol.polarity')} AS p
       FROM labels l JOIN pol ON pol.doc_id = l.doc_id)"""


def _evaluated(spark, sf):
    """(doc_id, y, p): truth from the label, prediction = the lexicon sign label, scored in
    place on the labelled rows (no join back)."""
    lab = _labelled(spark, sf).select("doc_id", "text", F.col("label").alias("y"))
    scored = L.with_lexicon_polarity(lab, "text", lexicon_df(spark))
    return scored.select("doc_id", "y", T.sign_label("polarity").alias("p"))


@register("accuracy", f"""WITH {_EVAL_SQL}
SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM ev""")
def accuracy(spark, sf):
    a = EV.accuracy(_evaluated(spark, sf), "y", "p")
    return a.select(F.round("accuracy", 6).alias("accuracy"), "n")


@register("confusion", f"""WITH {_EVAL_SQL},
labs AS (SELECT DISTINCT y AS c FROM ev UNION SELECT DISTINCT p FROM ev),
cnt AS (SELECT y, p, count(*) AS n FROM ev GROUP BY y, p)
SELECT a.c AS "true", b.c AS pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM labs a CROSS JOIN labs b LEFT JOIN cnt ON cnt.y = a.c AND cnt.p = b.c""")
def confusion(spark, sf):
    return EV.confusion(_evaluated(spark, sf), "y", "p")


def _report_sql():
    per = """per AS (SELECT c AS row_name,
        sum(CASE WHEN y = c THEN 1 ELSE 0 END) AS support,
        sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS predicted,
        sum(CASE WHEN y = c AND p = c THEN 1 ELSE 0 END) AS tp
      FROM labs CROSS JOIN ev GROUP BY c),
m AS (SELECT row_name, support,
        CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr,
        CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM per),
m2 AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM m)"""
    return f"""WITH {_EVAL_SQL},
labs AS (SELECT DISTINCT y AS c FROM ev UNION SELECT DISTINCT p FROM ev),
{per}
SELECT row_name, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT sum(tp) FROM per) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6),
       round(sum(rc * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m2"""


@register("class_report", _report_sql())
def class_report(spark, sf):
    r = EV.class_report(_evaluated(spark, sf), "y", "p")
    return r.select("row_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("label_distribution", f"""WITH {_EVAL_SQL}
SELECT 'true' AS kind, y AS label, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY y
UNION ALL SELECT 'predicted', p, CAST(count(*) AS BIGINT) FROM ev GROUP BY p""")
def label_distribution(spark, sf):
    """E12 + E15: counts per class of the truth and of the predictions."""
    e = _evaluated(spark, sf)
    sides = F.array(F.struct(F.lit("true").alias("kind"), F.col("y").alias("label")),
                    F.struct(F.lit("predicted").alias("kind"), F.col("p").alias("label")))
    # one pass over the scored rows; the result has a row per kind and class
    return (e.select(F.explode(sides).alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.label").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("kind"), F.desc("n"), "label"))


@register("step_counts", f"""WITH {_SPLIT_SQL},
loaded AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id)),
cleaned AS (SELECT doc_id, quality, {clean_text_sql('text')} AS c FROM loaded),
kept AS (SELECT * FROM cleaned WHERE {strip_ws_sql('c')} <> '' AND quality IS NOT NULL),
ksplit AS (SELECT doc_id, quality, c,
    CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id)
              <= round(count(*) OVER (PARTITION BY quality) * {TEST}) THEN 'test' ELSE 'train' END AS split FROM kept),
voc AS (SELECT count(DISTINCT t) AS v FROM (SELECT unnest({index_tokens_sql('c')}) AS t FROM ksplit WHERE split = 'train'))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM loaded) AS loaded,
       (SELECT CAST(count(*) AS BIGINT) FROM kept) AS cleaned,
       (SELECT CAST(count(*) AS BIGINT) FROM ksplit WHERE split = 'train') AS train,
       (SELECT CAST(count(*) AS BIGINT) FROM ksplit WHERE split = 'test') AS test,
       (SELECT CAST(v AS BIGINT) FROM voc) AS vocabulary""")
def step_counts(spark, sf):
    """E14 (with B2): rows loaded, left after cleaning (no stemming here, so SQL can check it),
    train and test sizes, distinct tokens of the training side (before any cap). The trainer's own
    figures are those of ``step_counts_stemmed``."""
    lab = _labelled(spark, sf)
    cleaned = FI.drop_empty_clean(lab.withColumn("c", T.clean_text("text")), "c", "quality")
    # the counts read the cleaned rows several times: clean once
    cleaned = stored(cleaned.select("doc_id", "quality", "c"), "cleaned")
    split = _split(cleaned, "quality")
    train = split.where(F.col("split") == "train")
    vocab = (train.join(cleaned, "doc_id").select(F.explode_outer(T.index_tokens("c")).alias("t"))
             .where(F.col("t").isNotNull()).distinct())
    return EV.step_counts(loaded=lab, cleaned=split, train=train,
                          test=split.where(F.col("split") == "test"), vocabulary=vocab)


@register("step_counts_stemmed")
def step_counts_stemmed(spark, sf):
    """E14 as the trainer counts (no SQL: SQL cannot stem): rows loaded, left after cleaning and
    stemming, train and test sizes, distinct stems of the training side, MAX_TERMS at most."""
    lab = _labelled(spark, sf)
    stems = CL.features_tokens(lab.where(F.col("quality").isNotNull()), "text")
    # a filter before the table is written would stem each text once more
    stems = stored(stems.select("doc_id", "quality", CL.FEATURE_TOKENS, (T.strip_ws("__cleaned") != "").alias("kept")), "stemmed")
    stems = stems.where("kept").drop("kept")
    split = _split(stems, "quality")
    train = split.where(F.col("split") == "train")
    vocab = (train.join(stems, "doc_id").select(F.explode_outer(CL.FEATURE_TOKENS).alias("t"))
             .where(F.col("t").isNotNull()).distinct())
    return EV.step_counts(loaded=lab, cleaned=split, train=train, test=split.where(F.col("split") == "test"),
                          vocabulary=vocab.limit(CL.MAX_TERMS))


# --- labelling ------------------------------------------------------------------------------

@register("label_resume", f"""WITH pol AS {lexicon_polarity_sql(
    '(SELECT doc_id, substring(text, 1, 512) AS snippet FROM documents d '
    'WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))', 'doc_id', 'snippet')}
SELECT l.doc_id, d.text, d.lang, d.source, d.n_chars, {_LABEL_SQL} AS sentiment FROM labels l LEFT JOIN documents d USING (doc_id)
UNION ALL SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CASE WHEN polarity > 0 THEN 'positive' ELSE 'negative' END
FROM pol JOIN documents d USING (doc_id)""")
def label_resume(spark, sf):
    """D7 + D8 + H7: ``labels`` is the work already done; every other document is labelled
    by the default (lexicon) scorer on its first 512 characters and appended."""
    d = table(spark, sf, "documents")
    done = table(spark, sf, "labels", spread_rows=False).select("doc_id", _label_expr("quality").alias("sentiment"))
    return CL.label_remaining(d, done, "doc_id", "text", CL.lexicon_scorer(lexicon_df(spark)))


@register("label_progress", f"""WITH pol AS {lexicon_polarity_sql(
    '(SELECT doc_id, substring(text, 1, 512) AS snippet FROM documents)', 'doc_id', 'snippet')}
SELECT doc_id, CASE WHEN polarity > 0 THEN 'positive' ELSE 'negative' END AS sentiment FROM pol""")
def label_progress(spark, sf):
    """D7 + D8: every document is labelled by the lexicon scorer in steps whose results are saved as
    each of them ends."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    labelled = CL.label_saving_progress(d, "doc_id", "text", CL.lexicon_scorer(lexicon_df(spark)),
                                        shared_path(spark, "label-progress"), steps=4)
    return labelled.select("doc_id", "sentiment")


@register("label_batch", """
SELECT doc_id, CASE WHEN length(substring(text, 1, 512)) % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment FROM documents""")
def label_batch(spark, sf):
    """U1 + D7: a batch callable as the scorer (here: the parity of the snippet's length), in
    Arrow batches."""
    scorer = CL.pandas_scorer(lambda s: s.str.len().mod(2).map({0: "POSITIVE", 1: "other"}))
    d = table(spark, sf, "documents").select("doc_id", "text")
    return CL.label_with(d, "text", scorer).select("doc_id", "sentiment")


# --- trained classifier ------------------------------------------------------------------------
# SQL cannot train: its side gives the rows, classes and the guard, ours adds whether each
# prediction is a class with a confidence that two classes allow. ``model_report`` has the figures.

_KEPT_SQL = f"""loaded AS (SELECT d.doc_id, d.text, {_LABEL_SQL} AS label FROM documents d JOIN labels l USING (doc_id)),
kept AS (SELECT doc_id, label FROM (SELECT doc_id, label, {clean_text_sql('text')} AS c FROM loaded)
         WHERE {strip_ws_sql('c')} <> '' AND label IS NOT NULL),
ksplit AS (SELECT doc_id, label,
    CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id)
              <= round(count(*) OVER (PARTITION BY label) * {TEST}) THEN 'test' ELSE 'train' END AS split FROM kept)"""


def _kept(spark, sf):
    """Labelled documents whose cleaned text is not empty (B2, before the split)."""
    lab = _labelled(spark, sf).select("doc_id", "text", "label")
    return FI.drop_empty_clean(lab.withColumn("c", T.clean_text("text")), "c", "label").drop("c")


def _model(spark, sf):
    """The model trained on the train side, the kept rows and their split."""
    kept = stored(_kept(spark, sf), "labelled")
    split = _split(kept, "label").select("doc_id", "split")
    rows = kept.join(split, "doc_id")
    return CL.train_classifier(rows.where(F.col("split") == "train"), "text", "label"), rows


def _sound(label, confidence):
    return F.col(label).isin("positive", "negative") & F.col(confidence).between(0.5, 1.0)


@register("train_predict", f"WITH {_KEPT_SQL} SELECT doc_id, label, TRUE AS sound FROM ksplit WHERE split = 'test'")
def train_predict(spark, sf):
    """E7 + E8: every held-out row is predicted; ``sound``: a class, with a possible confidence."""
    model, rows = _model(spark, sf)
    out = CL.predict(model, rows.where(F.col("split") == "test").select("doc_id", "text", "label"))
    return out.select("doc_id", "label", _sound("prediction_label", "confidence").alias("sound"))


@register("sample_predictions", f"""WITH {_KEPT_SQL}
SELECT doc_id, label, TRUE AS sound, TRUE AS shown FROM kept
ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id LIMIT 1000""")
def sample_predictions(spark, sf):
    """E13 + B7: the seeded sample of min(1000, N) labelled rows with ``Model_Prediction`` and
    the older app's display line (``shown``: it names the predicted class)."""
    model, rows = _model(spark, sf)
    out = CL.predict(model, FI.sample_n(rows.select("doc_id", "text", "label"), "doc_id", 1000, SEED))
    line = T.display_prediction_v1("prediction_label", "confidence")
    return out.select("doc_id", "label", _sound("prediction_label", "confidence").alias("sound"),
                      F.contains(F.lower(line), F.col("prediction_label")).alias("shown"))


@register("model_report")
def model_report(spark, sf):
    """E9-E12 for the trained model: on the held-out rows and on the seeded 500-row sample of all
    labelled rows (which holds training rows, as the older app's does): the class report, the
    confusion counts as rows ``true>predicted``, and the share of the largest class."""
    model, rows = _model(spark, sf)
    test = rows.where(F.col("split") == "test").select("doc_id", "text", "label")
    sample = FI.sample_n(rows.select("doc_id", "text", "label"), "doc_id", SAMPLE_N, SEED)
    out = None
    for name, part in (("held_out", test), ("sample", sample)):
        scored = stored(CL.predict(model, part).select("label", F.col("prediction_label").alias("p")), "predicted")
        report = EV.class_report(scored, "label", "p")
        empty = F.lit(None).cast("double")
        cells = EV.confusion(scored, "label", "p").select(
            F.concat("true", F.lit(">"), "pred").alias("row_name"), empty.alias("precision"), empty.alias("recall"),
            empty.alias("f1"), F.col("n").alias("support"))
        largest = scored.groupBy("label").count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).select(
            F.lit("majority class").alias("row_name"), empty.alias("precision"), empty.alias("recall"),
            (F.col("m") / F.col("n")).alias("f1"), F.col("n").alias("support"))
        one = report.unionByName(cells).unionByName(largest).select(F.lit(name).alias("rows"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("scored_by_model", f"""
SELECT doc_id, text, lang, source, n_chars, {strip_ws_sql(clean_text_sql('text'))} = '' AS guarded, TRUE AS sound FROM documents""")
def scored_by_model(spark, sf):
    """D4 + D5 + D6 with the model engine: every document, all columns; ``guarded``: text that
    is empty after cleaning got neutral and 0."""
    model, _ = _model(spark, sf)
    d = table(spark, sf, "documents")
    out = L.bulk_score(d, "text", engine="model", model=model, display=False)
    guarded = (F.col("Sentiment") == "neutral") & (F.col("Confidence") == 0)
    return out.select(*d.columns, guarded.alias("guarded"), (guarded | _sound("Sentiment", "Confidence")).alias("sound"))


@register("model_roundtrip", "SELECT doc_id, TRUE AS same FROM documents")
def model_roundtrip(spark, sf):
    """Save to the shared folder, load back, same predictions on every document."""
    model, _ = _model(spark, sf)
    path = shared_path(spark, "model")
    model.save(path)
    back = CL.TextModel.load(path, "text")
    d = table(spark, sf, "documents").select("doc_id", "text")
    a = CL.predict(model, d).withColumnRenamed("prediction_label", "a").drop("confidence")
    return CL.predict(back, a).select("doc_id", (F.col("a") == F.col("prediction_label")).alias("same"))


@register("stem_vocab")
def stem_vocab(spark, sf):
    """Every distinct cleaned token of the documents with its count and Porter stem."""
    d = table(spark, sf, "documents")
    return S.stem_vocabulary(d, T.clean_tokens("text"))


@register("clean_and_stem")
def clean_and_stem(spark, sf):
    """The full cleaner, stems included."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.clean_and_stem_col("text").alias("cleaned"))
