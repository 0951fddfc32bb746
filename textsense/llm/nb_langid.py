"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training tasks add up n-gram counts in one array of hash buckets per language and emit only the
buckets they met; Spark adds those up by (language, bucket). The matrix of smoothed log
probabilities is broadcast in parts of at most ``part_languages`` languages (so of a fixed size),
one part after the other when there are more. Texts are scored in batches: a text's n-grams are
counted by bucket, piece by piece, and the counts of the buckets it has, a sparse row, are
multiplied with their rows of the matrix, so a text of any length takes bounded memory.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or when no
document can be learnt from; ties go to the language first in order; rows with a null language
are not learnt from; whole texts count; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, seeds, slices, stored

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
PART_LANGUAGES = 64  # languages of one part of the matrix
HELD_COUNTS = 16  # languages whose count arrays a training task holds at a time
PIECE = 1 << 18  # characters counted at a time
_CODE = seeds(8, 31)


def buckets(text: str) -> np.ndarray:
    """Hash buckets of all character n-grams of a lower-cased text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = (h ^ c[j:j + len(h)]) * _CODE[j]
                h ^= h >> np.uint64(29)
            out.append(((h * _CODE[7]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def counts(text: str) -> np.ndarray:
    """How often a text's n-grams fall into each bucket."""
    text, out, most = text.lower(), np.zeros(1 << BUCKET_BITS, dtype=np.int64), max(ORDERS)
    for a in range(0, len(text), PIECE):
        b = min(a + PIECE, len(text))
        out += np.bincount(buckets(text[a:b + most - 1]), minlength=1 << BUCKET_BITS)
        # n-grams that start in the next piece's part of this one are counted there
        if b < len(text):
            out -= np.bincount(buckets(text[b:b + most - 1]), minlength=1 << BUCKET_BITS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Part:
    """Some languages, in order, and their columns of the matrix."""

    languages: list
    log_prob: np.ndarray   # buckets x languages
    log_prior: np.ndarray


@dataclass(frozen=True)
class Model:
    """The stored n-gram counts (lang, bucket, n), bucket -1 with the number of documents."""

    counts: DataFrame
    part_languages: int
    n_docs: int

    def parts(self):
        """The model's parts, read one at a time."""
        after = None
        while True:
            langs = self.counts.where("bucket = -1") if after is None else self.counts.where((F.col("bucket") == -1) & (F.col("lang") > after))
            some = langs.orderBy("lang").limit(self.part_languages).collect()
            if not some:
                return
            names = [r["lang"] for r in some]
            found = self.counts.where((F.col("bucket") >= 0) & F.col("lang").isin(names)).toArrow()  # part_languages x buckets rows at most
            table = np.full((1 << BUCKET_BITS, len(names)), SMOOTHING)
            lang = found["lang"].combine_chunks().dictionary_encode()
            col = np.array([names.index(x) for x in lang.dictionary.to_pylist()], dtype=np.int64)
            if found.num_rows:
                table[found["bucket"].to_numpy(), col[lang.indices.to_numpy()]] += found["n"].to_numpy()
            prior = np.log(np.array([r["n"] for r in some], dtype=float) / max(self.n_docs, 1))
            yield Part(names, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32), prior)
            after = names[-1]


def train(docs: DataFrame, text_col: str, lang_col: str, part_languages: int = PART_LANGUAGES) -> Model:
    """Learn from every row with a language and a letter."""
    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
              .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))

    def count(batches):
        import pyarrow as pa
        held: dict = {}

        def emit():
            for lang, (n, c) in held.items():
                at = np.flatnonzero(c)
                # bucket -1 carries the number of documents
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()),
                     pa.array(np.append(c[at], n), pa.int64())], names=["lang", "bucket", "n"])
            held.clear()
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not has_letter(text):
                        continue
                    if lang not in held and len(held) >= HELD_COUNTS:
                        yield from emit()
                    n, c = held.get(lang, (0, None))
                    b = counts(text)
                    if c is None:
                        c = b
                    else:
                        c += b
                    held[lang] = (n + 1, c)
        yield from emit()

    found = stored(src.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngram-counts")
    return Model(found, part_languages, found.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def predict(docs: DataFrame, text_col: str, model: Model, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the likeliest language and its posterior probability."""
    sc, parts = docs.sparkSession.sparkContext, model.parts()
    part, best, top, total = next(parts, None), *(free_name(docs, x) for x in ("nb_lang", "nb_top", "nb_total"))
    out, first = docs, True
    while first or part is not None:
        following = next(parts, None)
        out = _score(out, text_col, sc.broadcast(part), first, following is None, (best, top, total), (lang_out, score_out))
        if following is not None:
            out = stored(out, "language-scores")
        part, first = following, False
    return out


def _score(df: DataFrame, text_col: str, held, first: bool, last: bool, names: tuple, outs: tuple) -> DataFrame:
    """``df`` with the best language of the parts so far, its log score, and the sum over all of
    their languages' scores relative to it; after the last part with the two results instead."""
    from pyspark.sql import types as T
    at, before = df.columns.index(text_col), [df.columns.index(x) for x in names] if not first else []
    gone = {x.lower() for x in (outs if last else ())} | {x.lower() for x in names}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    new = list(zip(outs, ("string", "double"))) if last else list(zip(names, ("string", "double", "double")))
    schema = T.StructType([df.schema.fields[i] for i in kept] + T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in new)).fields)

    def run(batches):
        import pyarrow as pa
        m = held.value

        def one(text, lang, top, total):
            if m is None or not has_letter(text):
                return lang, top, total
            c = counts(text)
            met = np.flatnonzero(c)
            s = m.log_prior + c[met] @ m.log_prob[met]
            best = int(np.argmax(s))
            if lang is None or s[best] > top:
                total = (0.0 if lang is None else total * np.exp(max(top - s[best], -700))) + np.exp(np.maximum(s - s[best], -700)).sum()
                return m.languages[best], float(s[best]), float(total)
            return lang, top, float(total + np.exp(np.maximum(s - top, -700)).sum())
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                known = [part.column(i).to_pylist() for i in before] if before else [[None] * part.num_rows, [0.0] * part.num_rows, [0.0] * part.num_rows]
                got = [one(*x) for x in zip(part.column(at).to_pylist(), *known)]
                cols = [[g[k] for g in got] for k in range(3)]
                if last:
                    cols = [["und" if x is None else x for x in cols[0]], [0.0 if x is None else 1 / t for x, t in zip(cols[0], cols[2])]]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *[pa.array(c, pa.string() if k == 0 else pa.float64())
                                                                                    for k, c in enumerate(cols)]], names=schema.names)
    return df.mapInArrow(run, schema)
