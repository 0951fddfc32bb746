"""Trained-model sentiment and batch labelling (ids A9, D4, D5, D7, D8, E7, E8, E13, H7, U1).

Model: cleaned, stemmed text (C10) -> unigram index tokens (C11) -> TF-IDF with the
vocabulary (top 5,000 by corpus count) and smoothed idf of ``operators.vocab`` fitted on the
training rows only -> L2 normalisation -> multinomial/binomial logistic regression with L2
penalty. ``regParam = 1 / n_train`` with no standardisation gives the same objective as the
library's ``C = 1`` (sum of log-losses + ||w||^2 / 2).

Everything after the text columns is a Spark ML ``PipelineModel`` (string indexer,
count vectoriser built from our vocabulary, idf scaling, normaliser, logistic regression),
so training is distributed L-BFGS and save/load is ML persistence (A9), never pickles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IndexToString, Normalizer,
                                StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from . import stem as S
from . import vocab as V

FEATURE_TOKENS = "__tokens"
NEUTRAL = ("neutral", 0.0)
VECTOR_BYTES = 32 << 20
MAX_TERMS = 5000


def features_tokens(df: DataFrame, col: str, out: str = FEATURE_TOKENS) -> DataFrame:
    """C10 then C11 on the cleaned text: the classifier's unigrams."""
    return df.withColumn("__cleaned", S.clean_and_stem_col(col)).withColumn(
        out, T.index_tokens("__cleaned"))


@dataclass
class TextModel:
    pipeline: PipelineModel
    text_col: str

    def save(self, path: str) -> None:
        """ML persistence (overwrites)."""
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str, text_col: str = "text") -> "TextModel":
        """Missing artifacts -> an explicit 'train first' error."""
        try:
            return TextModel(PipelineModel.load(path), text_col)
        except Exception as exc:  # noqa: BLE001
            msg = str(exc)
            if "does not exist" in msg or "Path does not exist" in msg or "FileNotFound" in msg:
                raise FileNotFoundError(
                    f"classifier artifacts not found at {path}; run the training job first") from exc
            raise RuntimeError(f"failed to load classifier artifacts: {exc}") from exc

    def transform(self, df: DataFrame, keep_cleaned: bool = False) -> DataFrame:
        """Adds ``prediction_label`` and ``confidence`` (max class probability), and the
        cleaned, stemmed text ``__cleaned`` if asked for."""
        d = features_tokens(df, self.text_col)
        out = self.pipeline.transform(d)
        out = out.withColumn("confidence", F.array_max(vector_to_array("probability")))
        return out.drop(FEATURE_TOKENS, *([] if keep_cleaned else ["__cleaned"]), "__tf", "__tfidf", "features", "rawPrediction",
                        "probability", "prediction", "__label_idx")


def train_classifier(df: DataFrame, col: str, label: str, max_terms: int = MAX_TERMS,
                     max_iter: int = 1000) -> TextModel:
    """E7 on labelled rows; rows whose cleaned text is empty are dropped first (B2).

    The text is cleaned and stemmed once, at full parallelism, into a stored table of tokens
    and labels; every later pass (vocabulary, indexer, L-BFGS) reads that table."""
    from ..session import stored
    rows = features_tokens(df.where(F.col(label).isNotNull()), col)
    # a filter before the table is written would stem each text once more
    rows = stored(rows.select(FEATURE_TOKENS, label, (T.strip_ws("__cleaned") != "").alias("__kept")), "train-tokens")
    rows = rows.where("__kept").drop("__kept")
    tot = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(FEATURE_TOKENS)).alias("terms")).first()
    n_train = tot["n"]
    if n_train == 0:
        raise ValueError("no training rows")
    d = rows
    counts = V.term_counts(d.withColumn("__row", F.monotonically_increasing_id()), "__row", None,
                           ngram=(1, 1), tokens=F.col(FEATURE_TOKENS))
    vocab = V.Vocabulary(V.build_vocab(counts, n_train, max_terms), n_train)
    # the fitted model keeps its terms, and a weight for each, on the driver: with
    # ``max_terms=None`` that is the whole vocabulary, by the nature of the ML classes
    rows = sorted(vocab.df.select("term", "idf").collect(), key=lambda r: r["term"].encode("utf-8"))
    terms = [r["term"] for r in rows]
    idf = [float(r["idf"]) for r in rows] or [1.0]
    indexer = StringIndexer(inputCol=label, outputCol="__label_idx", stringOrderType="alphabetAsc").fit(d)
    cv = CountVectorizerModel.from_vocabulary(terms or ["__none__"], inputCol=FEATURE_TOKENS, outputCol="__tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf")
    norm = Normalizer(p=2.0, inputCol="__tfidf", outputCol="features")
    prep = PipelineModel(stages=[indexer, cv, scale, norm])
    lr = LogisticRegression(featuresCol="features", labelCol="__label_idx", regParam=1.0 / n_train,
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-4)
    # an iteration is one job over the compact vectors: partitions of VECTOR_BYTES (an index
    # and a weight for each term at most), however many rows that is
    vectors = stored(prep.transform(d).select("features", "__label_idx"), "train-vectors")
    lr_model = lr.fit(vectors.coalesce(max(1, -(-12 * tot["terms"] // VECTOR_BYTES))))
    back = IndexToString(inputCol="prediction", outputCol="prediction_label", labels=indexer.labels)
    return TextModel(PipelineModel(stages=[indexer, cv, scale, norm, lr_model, back]), col)


def predict(model: TextModel, df: DataFrame) -> DataFrame:
    """E8."""
    return model.transform(df)


def model_sentiment(df: DataFrame, col: str, model: TextModel, empty=NEUTRAL, display: bool = True) -> DataFrame:
    """D4 + D5: every input column plus ``Sentiment`` and ``Confidence`` (3 decimals); text
    that is empty after cleaning gets ``empty`` (neutral, 0.0) without a model answer."""
    m = TextModel(model.pipeline, col)
    # the text is cleaned and stemmed once, for the features and for the guard
    out = m.transform(df, keep_cleaned=True).withColumn("__empty", T.strip_ws("__cleaned") == "")
    label = F.when(F.col("__empty"), F.lit(empty[0])).otherwise(F.col("prediction_label"))
    conf = F.when(F.col("__empty"), F.lit(float(empty[1]))).otherwise(T.round3("confidence"))
    return out.select(*df.columns, (T.display_label(label) if display else label).alias("Sentiment"),
                      conf.alias("Confidence"))


# --- D7 / D8 / U1 ------------------------------------------------------------------------

def lexicon_scorer(lexicon: DataFrame):
    """The default scorer (runs offline): lexicon polarity > 0 -> positive, else negative."""
    from .lexicon import polarity_from_sum, polarity_of_looked, with_looked_up

    def score(df: DataFrame, col: str, out: str) -> DataFrame:
        d = (with_looked_up(df, T.index_tokens(col), lexicon, "__lk")
               .withColumn("__sum", polarity_of_looked("__lk")))
        return (d.withColumn(out, F.when(polarity_from_sum("__sum") > 0, "positive").otherwise("negative"))
                 .drop("__lk", "__sum"))
    return score


def pandas_scorer(fn):
    """Wrap a batch callable ``pd.Series[str] -> pd.Series[str]`` (e.g. a local classifier)
    as a scorer; it runs in Arrow batches inside the tasks."""
    import pandas as pd
    from pyspark.sql.types import StringType

    udf = F.pandas_udf(lambda s: pd.Series(fn(s)), StringType())

    def score(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.withColumn(out, udf(F.col(col)))
    return score


_LOADED: dict = {}  # a worker's set-up objects, by their name; they live as long as the worker


def loaded_scorer(load, fn, name: str):
    """A scorer with a set-up that is done once in each Python worker, whatever its number of
    tasks and batches: ``load()`` makes the object (a model, say), and ``fn(object,
    pd.Series[str]) -> pd.Series[str]`` answers with it. ``name`` tells set-ups apart: a new model needs a new name."""
    import pandas as pd
    from pyspark.sql.types import StringType

    def run(batches):
        from textsense.operators import classify as here  # the worker's own module
        if name not in here._LOADED:
            here._LOADED[name] = load()
        for s in batches:
            yield pd.Series(fn(here._LOADED[name], s))
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, StringType())

    def score(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.withColumn(out, udf(F.col(col)))
    return score


def label_with(df: DataFrame, col: str, scorer, max_chars: int = 512, out: str = "sentiment",
               positive: str = "positive", negative: str = "negative") -> DataFrame:
    """Label every row with ``scorer`` on the first ``max_chars`` characters; the
    scorer's positive class -> positive, anything else -> negative (binary)."""
    d = df.withColumn("__snippet", T.prefix(col, max_chars))
    d = scorer(d, "__snippet", "__raw")
    lab = F.when(F.lower(F.col("__raw")) == positive, F.lit(positive)).otherwise(F.lit(negative))
    return d.withColumn(out, lab).drop("__snippet", "__raw")


def label_remaining(df: DataFrame, done: DataFrame, key: str, col: str, scorer, out: str = "sentiment",
                    max_chars: int = 512) -> DataFrame:
    """Label only rows whose key is not in ``done`` (an anti join), return them
    appended to ``done`` -- resuming twice gives the same table as resuming once. All columns of
    ``df`` are kept (null for labelled keys that ``df`` lacks)."""
    new = label_with(df.join(done.select(key), key, "left_anti"), col, scorer, max_chars, out)
    rest = [c for c in df.columns if c not in (key, out)]
    known = done.select(key, out).join(df.select(key, *rest), key, "left")
    return known.select(key, *rest, out).unionByName(new.select(key, *rest, out))


def label_saving_progress(df: DataFrame, key: str, col: str, scorer, path: str, out: str = "sentiment",
                          max_chars: int = 512, steps: int = 16) -> DataFrame:
    """D8 with progress that is saved as it goes: all rows of ``df`` with their label, under ``path``.

    Rows are dealt by a hash of their key into ``steps`` steps and written so, once
    (``input/step=<s>``); each step is then a job of its own that reads its rows only and writes
    ``labelled/step=<s>``. A folder counts when Spark has committed it (its ``_SUCCESS`` file): a run
    that is started again after a failure labels the steps that are missing and no other. Rows
    with a null key are one step's. Give the same table, key and ``steps`` to go on with a run: the
    input of the first run is what gets labelled."""
    spark = df.sparkSession
    path = path.rstrip("/")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    committed = lambda folder: fs.exists(hadoop_path(f"{folder}/_SUCCESS"))
    if not committed(f"{path}/input"):
        dealt = df.withColumn("__step", F.pmod(F.xxhash64(key), F.lit(steps)))
        dealt.write.mode("overwrite").partitionBy("__step").parquet(f"{path}/input")
    for step in range(steps):
        done = f"{path}/labelled/step={step}"
        rows = f"{path}/input/__step={step}"
        if committed(done) or not fs.exists(hadoop_path(rows)):
            continue
        label_with(spark.read.schema(df.schema).parquet(rows), col, scorer, max_chars, out).write.mode("overwrite").parquet(done)
    parts = [f"{path}/labelled/step={s}" for s in range(steps) if committed(f"{path}/labelled/step={s}")]
    kept = [c for c in df.columns if c != out]
    if not parts:
        return df.limit(0).select(*kept, F.lit("").alias(out))
    return spark.read.parquet(*parts).select(*kept, out)
