"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each document is reduced to a few statistics of its whole text. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; every partition of the training rows adds
up its part of the normal equations, the sum is solved once (its size is fixed by the number of
features), and raw scores are calibrated by isotonic regression on labelled rows that the fit
has not seen. Scoring is a row-wise pass; the model is a few thousand numbers.

Training uses at most ``max_train`` labelled rows (a documented bound; chosen by a hash of the
id); scoring uses all. Labels are joined to the statistics, never to texts.

Defined results: a null or empty text has statistics of zero and is scored as such; labels that
are null, or whose document is missing, are left out; with no labels, or one class only, every
score is that class's share (0.5 for none); rows with equal ids each get a score; extra columns
pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, free_name, gram_hashes, stored, word_hashes

N_FOURIER = 256
BANDWIDTH = 4.0
RIDGE = 1e-3
MAX_TRAIN = 200_000
TRAIN_PARTS = 32
BINS_PER_UNIT = 512

_KIND = np.zeros(256, dtype=np.int64)  # byte -> class
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
_KIND[[ord(c) for c in "#*$%&|<>@/\\^_~=+{}[]`"]] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 7
_KIND[128:] = 8
STATS = ("log_words", "lower", "upper", "digit", "stop", "symbol", "shout", "space", "wide", "word_length",
         "distinct", "top_word", "stutter", "repeat", "line_words", "dup_lines")


def statistics(text: str | None) -> list[float]:
    """The statistics named in STATS of one whole text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    words = word_hashes(data)
    n, size = len(words), max(len(data), 1)
    if n == 0:
        return [0.0] * len(STATS)
    kinds = np.bincount(_KIND[data], minlength=9) / size
    _, times = np.unique(words, return_counts=True)
    grams = np.unique(gram_hashes(words, 5), return_counts=True)[1]
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return [float(x) for x in (
        np.log1p(n), *kinds[1:9], (len(data) - kinds[7] * size) / n, len(times) / n ** 0.8, times.max() / n,
        float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0, grams[grams > 1].sum() / grams.sum(),
        np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1))]


def with_statistics(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with an array<double> column of statistics."""
    def make():
        import pyarrow as pa
        return lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]
    return append_columns(docs, text_col, make, [(out, "array<double>")])


@dataclass(frozen=True)
class Model:
    """Everything that scoring needs; constant for a training set without both classes."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    constant: float | None = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features((stats - self.mean) / self.scale) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        flat = np.interp(raw, self.knots, self.levels)
        return 0.999 * flat + 0.001 / (1 + np.exp(-np.clip(8 * (raw - 0.5), -50, 50)))  # keeps the order where flat


def features(x: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant; the directions are the same everywhere."""
    rng = np.random.default_rng(7)
    w = rng.normal(0, 1 / BANDWIDTH, (len(STATS), N_FOURIER))
    b = rng.uniform(0, 2 * np.pi, N_FOURIER)
    z = np.cos(np.clip(x, -8, 8) @ w + b) * np.sqrt(2 / N_FOURIER)
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (mean position, sum of labels, rows), in order of x:
    knots and non-decreasing levels."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([a / c for a, _, c in blocks]), np.array([b / c for _, b, c in blocks])


def train(rows: DataFrame, stats_col: str, label_col: str, key: Column, max_train: int = MAX_TRAIN) -> Model:
    """``rows``: statistics and a 0/1 label. Two thirds (by a hash of ``key``) fit the ridge, the
    rest calibrates."""
    from pyspark.sql import types as T
    rows = rows.where(F.col(label_col).isin(0, 1)).select(
        F.col(stats_col).alias("x"), F.col(label_col).cast("double").alias("y"), F.pmod(F.xxhash64(key), F.lit(3 << 20)).alias("u"))
    d = len(STATS)
    tot = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"),
                   *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(d)],
                   *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]).first()
    n, p = tot["n"], tot["p"] or 0.0
    empty = np.zeros(0)
    if n == 0 or p in (0.0, float(n)):
        return Model(empty, empty, empty, empty, empty, 0.5 if n == 0 else p / n)
    mean = np.array([tot[f"m{i}"] for i in range(d)])
    scale = np.maximum(np.array([tot[f"s{i}"] for i in range(d)]), 1e-6)
    rows = rows.where(F.floor(F.col("u") / 3) < int(min(1.0, max_train / n) * (1 << 20)))
    rows = stored(rows.repartition(TRAIN_PARTS), "training")
    k = N_FOURIER + 1

    def sums(batches):
        import pyarrow as pa
        a, c = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, d)
            if len(x):
                z = features((x - mean) / scale)
                a += z.T @ z
                c += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([[*r, v] for r, v in zip(a.tolist(), c.tolist())],
                                                                                  pa.list_(pa.float64()))], names=["i", "v"])

    fit = rows.where(F.col("u") % 3 != 0)
    # k + 1 numbers for each of k indices and partition, added up by index and position
    parts = fit.mapInArrow(sums, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")) \
               .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    normal = np.zeros((k, k + 1))
    for r in parts:
        normal[r["i"], r["j"]] = r["v"]
    m = normal[k - 1, k - 1]
    weight = np.linalg.solve(normal[:, :k] + RIDGE * max(m, 1.0) / k * np.eye(k), normal[:, k])
    bare = Model(mean, scale, weight, empty, empty)

    def raw(batches):
        import pyarrow as pa
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(bare.raw(x) if len(x) else [], pa.float64()), batch.column(1)],
                                             names=["r", "y"])

    seen = rows.where(F.col("u") % 3 == 0).select("x", "y").mapInArrow(
        raw, T.StructType([T.StructField("r", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    # scores outside [-1, 2] share a bin, so there are at most 3 * BINS_PER_UNIT + 1
    bins = seen.groupBy(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "r")) * BINS_PER_UNIT).alias("b")) \
               .agg(F.avg("r").alias("r"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    if not bins:
        return Model(empty, empty, empty, empty, empty, p / n)
    knots, levels = isotonic(*(np.array([r[c] for r in bins], dtype=float) for c in ("r", "y", "n")))
    return Model(mean, scale, weight, knots, levels)


def score(df: DataFrame, stats_col: str, model: Model, out: str) -> DataFrame:
    """``df`` with the calibrated score, 0 to 1."""
    @F.pandas_udf("double")
    def apply(stats):
        import pandas as pd
        if not len(stats):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array(stats.tolist()).reshape(-1, len(STATS))))
    return df.withColumn(out, apply(F.col(stats_col)))


def fit(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str,
        learn: Column | None = None, max_train: int = MAX_TRAIN) -> tuple[Model, DataFrame]:
    """The model and the stored statistics (id, stats) of every row. ``learn`` is a condition on
    column ``id``: the rows whose labels may be used."""
    stats = stored(with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", "stats").drop("t"), "statistics")
    return _fit(stats, labels, label_id, label_col, learn, max_train), stats


def _fit(stats: DataFrame, labels: DataFrame, label_id: str, label_col: str, learn: Column | None, max_train: int) -> Model:
    use = stats if learn is None else stats.where(learn)
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("label"))
    return train(use.join(known, "id"), "stats", "label", F.col("id"), max_train)


def keep_good(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str,
              learn: Column | None = None, least: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` whose score is at least ``least``, columns unchanged; all of them if the labels
    lack a class, as nothing can be told apart then. Statistics are taken once: the documents are
    written with them."""
    s, p = free_name(docs, "fq_stats"), free_name(docs, "fq_score")
    held = stored(with_statistics(docs, text_col, s), "with-statistics")
    model = _fit(held.select(F.col(f"`{id_col}`").alias("id"), F.col(s).alias("stats")), labels, label_id, label_col, learn, max_train)
    if model.constant is not None:
        return docs
    scored = score(held, s, model, p)
    return scored.where(F.col(p) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
