"""Toxicity: a convolutional text classifier in numpy.

A word (a run of letters, digits and non-ASCII characters, A-Z lower-cased) has two hash
buckets, one of the whole word and one of its first STEM bytes; its embedding is the sum of two
table rows, so that endings share what they have in common and two words share all only if both
buckets collide. Filters of widths 1 to 3 run over a text's word sequence, each filter's
largest value over the whole text is kept (texts are read in blocks, whatever their length),
and a logistic layer scores these maxima.

Training goes by rounds. Each chunk of training rows takes the current parameters, makes one pass
over its rows in small batches (Adagrad; a gradient reaches only the windows that were the
maxima) and hands its parameters over; the next round starts from their mean, weighted by
rows. All labelled rows are used, in chunks of about TRAIN_ROWS rows, cut only where a file is read
in parts. A task learns up to FAN chunks one after the other and sends on their mean; these are
added up FAN at a time, so that neither a task nor the driver holds more sets than
that, whatever the number of rows. (A caller's own ``max_train`` bounds the rows by a hash of the
id.) Texts that may have a label become their words' buckets (two bytes each) before they are
dealt out; no text is shuffled or stored. One training row in five is kept out of the fit and
calibrates: the score's 0.5 is the threshold that parts these rows best, and each language with
enough of them has a threshold of its own for ``flagged``. The language never enters a score.

Defined results: a null or empty text is one window of padding and is scored as such; labels
that are null or not 0/1, or whose document is missing, are left out; a label repeated for one
id counts once, its largest value holds; rows with equal ids each get a score, equal ones are
learnt from once; with no labels, or one class only, every score is that class's share (0.5 for
none); extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODE, _TO_LOWER, HashFilter, _Powers, append_columns, mix64, seeds, slices, stored

BUCKET_BITS = 15
STEM = 5
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 16
BLOCK = 1 << 14            # windows held at a time
TRAIN_ROWS = 2_000         # rows of a training chunk, about
FAN = 16                   # parameter sets that one task, or the driver, adds up
ROUNDS = 6
BATCH = 16
RATE = 0.08
CALIBRATE = 5              # one training row in so many calibrates
LANG_ROWS = 200            # calibration rows that a language's own threshold needs
STEPS = 400                # bins of scores for calibration
_U = np.uint64
_PAD = 1 << BUCKET_BITS    # the tables' last row, always zero

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_buckets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Both buckets of the words of ``texts`` (2 x words), in order, and where each text's words
    start (and end)."""
    blobs = [(t or "").encode() for t in texts]
    data = _TO_LOWER[np.frombuffer(b" ".join(blobs), dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(_WORD[data], prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    up, down = _Powers.get(len(data) + 1)
    total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(_BYTE_CODE[data] * up[:len(data)])])
    stem = np.minimum(end, start + STEM)
    both = [(mix64((total[e] - total[start]) * down[start] ^ (e - start).astype(_U)) >> _U(64 - BUCKET_BITS)).astype(np.int32) for e in (end, stem)]
    at = np.cumsum([0, *[len(b) + 1 for b in blobs]])
    return np.stack(both), np.searchsorted(start, at)


def padded(buckets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both buckets at each place of a sequence in which padding follows every text, as long as
    the widest filter needs; the text of each place, and whether a window may start there."""
    pad = max(WIDTHS) - 1
    n = np.diff(cuts)
    size = np.maximum(n, 1) + pad
    first = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), size)
    at = np.arange(buckets.shape[1]) + (first[:-1] - cuts[:-1])[np.repeat(np.arange(len(n)), n)]
    one, two = np.full(first[-1], _PAD, dtype=np.int32), np.full(first[-1], _PAD, dtype=np.int32)
    one[at], two[at] = buckets
    return one, two, doc, np.arange(first[-1]) - first[:-1][doc] < np.maximum(n, 1)[doc]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Net:
    tables: list = field(default_factory=list)   # two of (buckets + 1) x DIM
    filters: list = field(default_factory=list)  # for each width: width x DIM x FILTERS
    bias: np.ndarray = None                      # of all filters
    out: np.ndarray = None                       # weight of each filter, and the constant

    @classmethod
    def fresh(cls, share: float) -> Net:
        rng = np.random.default_rng(5)
        tables = [rng.normal(0, 0.05, (_PAD + 1, DIM)).astype(np.float32) for _ in range(2)]
        for t in tables:
            t[_PAD] = 0
        filters = [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        # filters speak for or against
        out = np.append(np.where(np.arange(n) % 2, -1, 1) * 0.5, np.log(share / (1 - share))).astype(np.float32)
        return cls(tables, filters, np.zeros(n, dtype=np.float32), out)

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables, *self.filters, self.bias, self.out]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Net:
        return cls(arrays[:2], arrays[2:-2], arrays[-2], arrays[-1])

    def maxima(self, one, two, doc, starts, places: bool = False):
        """The largest value of each filter over each text's windows and, if asked for, the
        first window that has it."""
        docs, n = int(doc[-1]) + 1 if len(doc) else 0, len(self.bias)
        best = np.full((docs, n), -np.inf, dtype=np.float32)
        where = np.zeros((docs, n), dtype=np.int64)
        for a in range(0, len(one), BLOCK):
            b = min(a + BLOCK, len(one))
            x = self.tables[0][one[a:b + max(WIDTHS) - 1]] + self.tables[1][two[a:b + max(WIDTHS) - 1]]
            use = np.flatnonzero(starts[a:b])
            if not len(use):
                continue
            of = doc[a + use]
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                z = x[use] @ f[0]
                for j in range(1, w):
                    z += x[use + j] @ f[j]
                top = np.maximum.reduceat(z, cut, axis=0)
                here, cols = of[cut], slice(k * FILTERS, (k + 1) * FILTERS)
                if places:
                    i, c = np.nonzero(z == np.repeat(top, np.diff(np.append(cut, len(of))), axis=0))
                    row = (np.searchsorted(cut, i, side="right") - 1) * FILTERS + c
                    first = np.full(top.size, len(z), dtype=np.int64)
                    np.minimum.at(first, row, i)
                    at = (a + use)[first.reshape(top.shape)]
                    where[here, cols] = np.where(top > best[here, cols], at, where[here, cols])
                best[here, cols] = np.maximum(best[here, cols], top)
        return best + self.bias, where

    def logits(self, texts: list) -> np.ndarray:
        """Of each text, in pieces of bounded work."""
        return self.logits_of(*word_buckets(texts)) if texts else np.zeros(0)

    def logits_of(self, buckets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        top, _ = self.maxima(*padded(buckets, cuts))
        return (np.maximum(top, 0) @ self.out[:-1] + self.out[-1]).astype(np.float64)

    def learn(self, batches, rate: float = RATE) -> int:
        """One pass over (buckets, cuts, labels); the number of rows."""
        seen = 0
        held = [np.full(x.shape if i >= 2 else (len(x), 1), 1e-3, dtype=np.float32) for i, x in enumerate(self.arrays())]
        for buckets, cuts, y in batches:
            one, two, doc, starts = padded(buckets, cuts)
            top, at = self.maxima(one, two, doc, starts, True)
            act = np.maximum(top, 0)
            g = (sigmoid(act @ self.out[:-1] + self.out[-1]) - y).astype(np.float32) / len(y)
            d_out = np.append(act.T @ g, g.sum())
            d_top = (g[:, None] * self.out[:-1]) * (top > 0)
            grads = []
            ids, rows = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                d, t = d_top[:, cols], at[:, cols]
                df = np.empty_like(f)
                for j in range(w):
                    i1, i2 = one[t + j], two[t + j]
                    x = self.tables[0][i1] + self.tables[1][i2]          # texts x filters x DIM
                    df[j] = np.einsum("bfk,bf->kf", x, d)
                    live = (d != 0) & (i1 != _PAD)
                    back = (f[j].T[None] * d[:, :, None])[live]
                    ids.append((i1[live], i2[live]))
                    rows.append(back)
                grads.append(df)
            rows = np.concatenate(rows)
            for table, acc, some in zip(self.tables, held, zip(*ids)):
                some = np.concatenate(some)
                u, inv = np.unique(some, return_inverse=True)
                total = np.zeros((len(u), DIM), dtype=np.float32)
                np.add.at(total, inv, rows)
                acc[u] += (total ** 2).mean(axis=1, keepdims=True)
                table[u] -= rate * total / np.sqrt(acc[u])
            for x, acc, d in zip([*self.filters, self.bias, self.out], held[2:], [*grads, d_top.sum(axis=0), d_out]):
                acc += d * d
                x -= rate * 0.5 * d / np.sqrt(acc)
            seen += len(y)
        return seen


@dataclass(frozen=True)
class Model:
    """Parameters and the logit whose score is 0.5; constant for labels without both classes."""

    net: Net | None
    middle: float = 0.0
    constant: float | None = None

    def score(self, texts: list) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.net.logits(texts) - self.middle)


def _best_middle(bins: list) -> float:
    """Of (bin, rows, positive rows), ascending: the middle of the widest stretch of thresholds
    that part the rows with fewest errors."""
    edges = [bins[0][0], *[b + 1 for b, _, _ in bins]]
    right = sum(p for _, _, p in bins)  # at the least threshold all rows are called positive
    scores = [right]
    for _, n, p in bins:
        right += n - 2 * p
        scores.append(right)
    top, best = max(scores), None
    for i, s in enumerate(scores):
        if s == top:
            lo, hi = edges[i], bins[i][0] if i < len(bins) else edges[i]
            if best is None or hi - lo > best[1] - best[0]:
                best = (lo, hi)
    return (best[0] + best[1]) / 2


def _packed(buckets: np.ndarray) -> bytes:
    """Both buckets of a text's words in two bytes each."""
    return buckets.astype("<u2").tobytes()


def _unpacked(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Like ``word_buckets``, of texts that were packed."""
    words = [np.frombuffer(b, dtype="<u2").astype(np.int32).reshape(2, -1) for b in texts]
    return np.hstack(words), np.cumsum([0, *[w.shape[1] for w in words]])


def _by_chunk(batches):
    """(chunk, [(words, label)]) of at most BATCH rows of one chunk, wherever Arrow's batches end."""
    rows, of = [], None
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for c, b, y in zip(*[batch.column(i).slice(a, 256).to_pylist() for i in range(3)]):
                if rows and (c != of or len(rows) == BATCH):
                    yield of, rows
                    rows = []
                of = c
                rows.append((b, y))
    if rows:
        yield of, rows


_SENT = "at int, n bigint, x array<binary>"


def _sent(n: int, arrays: list[np.ndarray]):
    """A row of the parameters that ``n`` rows gave, with the place of the task."""
    import pyarrow as pa
    from pyspark import TaskContext
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()),
                                       pa.array([[x.astype("<f4").tobytes() for x in arrays]], pa.list_(pa.binary()))], names=["at", "n", "x"])


def _mean(table, like: Net) -> tuple[list[np.ndarray] | None, int]:
    """The mean of rows of ``_SENT``, weighted by their rows, and the rows (None and 0 of none)."""
    shapes = [x.shape for x in like.arrays()]
    mean, weight = [np.zeros(s, dtype=np.float64) for s in shapes], 0
    for n, arrays in zip(table["n"].to_pylist(), table["x"]):
        weight += n
        for m, b in zip(mean, arrays):
            m += n * np.frombuffer(b.as_buffer(), dtype="<f4").reshape(m.shape)
    return [(m / weight).astype(np.float32) for m in mean] if weight else None, weight


def _added(sent: DataFrame, parts: int, like: Net) -> DataFrame:
    """The rows of ``_SENT`` of ``parts`` tasks, brought to at most FAN rows of the same mean; in the
    order of the tasks, so that sums come out the same again."""
    shapes = Net.of([np.empty(x.shape, dtype=np.float32) for x in like.arrays()])

    def add(batches):
        import pyarrow as pa
        rows = [b for b in batches if b.num_rows]
        mean, weight = _mean(pa.Table.from_batches(rows), shapes) if rows else (None, 0)
        if weight:
            yield _sent(weight, mean)
    while parts > FAN:
        parts = -(-parts // FAN)
        sent = sent.repartitionById(parts, F.expr(f"cast(floor(at / {FAN}) as int)")).sortWithinPartitions("at").mapInArrow(add, _SENT)
    return sent


def fit(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, lang_col: str | None = None,
        learn: Column | None = None, max_train: int | None = None, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and (lang, threshold): the score that parts a language's calibration rows, for
    each language with enough of them. ``learn`` is a condition on column ``id``: the rows whose
    labels may be used."""
    spark = docs.sparkSession
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known if learn is None else known.where(learn)
    known = stored(known.groupBy("id").agg(F.max("y").alias("y")).withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "labels")
    none = spark.createDataFrame([], "lang string, threshold double")

    def bound(df: DataFrame) -> DataFrame:
        if max_train is None:
            return df
        n = df.count()
        return df.where(F.col("u") < int(min(1.0, max_train / max(n, 1)) * (1 << 20)))

    src = docs.select(F.col(id_col).alias("id"), (F.lit(None) if lang_col is None else F.col(lang_col)).cast("string").alias("lang"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    src = src if learn is None else src.where(learn)
    src = src.withColumn("k", F.xxhash64("id", "t")).withColumn("h", F.xxhash64("id"))
    id_type = src.schema["id"].dataType.simpleString()
    # most texts without a label go before the shuffle; the join decides
    plain = id_type in ("int", "bigint", "string") and id_type == known.schema["id"].dataType.simpleString()
    labelled = HashFilter(bound(known).select(F.xxhash64("id").alias("h")), "h") if plain else None

    def hashed(batches):
        import pyarrow as pa
        for batch in batches:
            if labelled is not None:
                batch = batch.filter(pa.array(labelled.may_have(batch.column(4).to_numpy(zero_copy_only=False))))
            for part in slices(batch, 2, 1 << 20):
                got = [_packed(word_buckets([t])[0]) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.binary()), part.column(3)],
                                                 names=["id", "lang", "b", "k"])
    # both sides are dealt by id at every size: the labels are never sent whole, and equal rows are
    # found where the join left them, without another shuffle of the words
    rows = src.select("id", "lang", "t", "k", "h").mapInArrow(hashed, f"id {id_type}, lang string, b binary, k bigint") \
              .join(bound(known).drop("u").hint("shuffle_hash"), "id").dropDuplicates(["id", "k"])
    rows = stored(rows, "training-rows").withColumn("u", F.pmod(F.xxhash64("k"), F.lit(1 << 20)))
    rows = bound(rows)
    tot = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n, p = tot["n"], tot["p"] or 0
    if n == 0 or p in (0, n):
        return Model(None, 0.0, 0.5 if n == 0 else p / n), none
    kept_out = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(CALIBRATE)) == 0
    chunks = max(1, -(-n // TRAIN_ROWS))
    tasks = min(chunks, max(-(-chunks // FAN), spark.sparkContext.defaultParallelism))
    fitted = rows.where(~kept_out).select(F.pmod(F.hash("k"), F.lit(chunks)).alias("c"), "k", "b", "y")
    fitted = stored(fitted.repartitionById(tasks, F.pmod("c", F.lit(tasks))).sortWithinPartitions("c", "k"), "training-words").select("c", "b", "y")
    net = Net.fresh(p / n)
    parts = fitted.rdd.getNumPartitions()
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(net.arrays())
        rate = RATE * (1 - 0.9 * turn / rounds)

        def one_pass(batches, held=held, rate=rate):
            total, weight = [], 0
            for _, chunk in groupby(_by_chunk(batches), key=lambda x: x[0]):
                mine = Net.of([x.copy() for x in held.value])
                seen = mine.learn(((*_unpacked([b for b, _ in rows]), np.array([y for _, y in rows], dtype=np.float32))
                                   for _, rows in chunk), rate)
                weight += seen
                new = [seen * x.astype(np.float64) for x in mine.arrays()]
                total = [a + b for a, b in zip(total, new)] if total else new
            if weight:
                yield _sent(weight, [x / weight for x in total])
        sent = _added(fitted.mapInArrow(one_pass, _SENT), parts, net).toArrow()
        mean, weight = _mean(sent, net)
        held.destroy()
        if weight == 0:  # every row calibrates
            break
        net = Net.of(mean)
    return _calibrated(rows.where(kept_out), net)


def _calibrated(rows: DataFrame, net: Net) -> tuple[Model, DataFrame]:
    held = rows.sparkSession.sparkContext.broadcast(net.arrays())

    def make():
        import pyarrow as pa
        mine = Net.of(held.value)
        return lambda texts: [pa.array(mine.logits_of(*_unpacked(texts)), pa.float64())]
    seen = append_columns(rows.select("lang", "y", "b"), "b", make, [("z", "double")])
    width = 40 / STEPS
    # logits outside [-20, 20] share a bin, so a language has at most STEPS + 1
    bins = stored(seen.groupBy("lang", F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "z")) / width).alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")), "calibration")
    every = [(r["b"], r["n"], r["p"]) for r in bins.groupBy("b").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).orderBy("b").collect()]
    n, p = sum(x[1] for x in every), sum(x[2] for x in every)
    middle = _best_middle(every) * width if 0 < p < n else 0.0

    def own(table):
        import pyarrow as pa
        some = sorted(zip(table["b"].to_pylist(), table["n"].to_pylist(), table["p"].to_pylist()))
        n, p = sum(x[1] for x in some), sum(x[2] for x in some)
        ok = n >= LANG_ROWS and 0 < p < n
        return pa.table({"lang": table["lang"][:1 if ok else 0], "threshold": pa.array(
            [float(sigmoid(_best_middle(some) * width - middle))] if ok else [], pa.float64())})
    own_level = bins.where("lang is not null").groupBy("lang").applyInArrow(own, "lang string, threshold double")
    return Model(net, middle), stored(own_level, "thresholds")


def score(docs: DataFrame, text_col: str, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1, of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa
        return lambda texts: [pa.array(held.value.score(texts), pa.float64())]
    return append_columns(docs, text_col, make, [(out, "double")], 1 << 20)


def flag(scored: DataFrame, score_col: str, lang_col: str, thresholds: DataFrame, out: str = "flagged") -> DataFrame:
    """``scored`` with whether its score reaches its language's threshold (0.5 without one)."""
    level = thresholds.select(F.col("lang").alias("__lang"), F.col("threshold").alias("__level"))
    return scored.join(level, F.col(lang_col).cast("string") == F.col("__lang"), "left") \
                 .withColumn(out, F.col(score_col) >= F.coalesce("__level", F.lit(0.5))).drop("__lang", "__level")
