"""Spelling variants of a corpus' words, by pivotal grams.

Words are counted in the tasks that read the texts. Bigrams are ordered by the number of words
that hold them, rarest first. A word's gram prefix is its three rarest bigrams (places count;
further places of the third one belong to it), and its pivots are the two disjoint bigrams of
that prefix with the least total frequency, chosen by dynamic programming.

One edit cannot touch both pivots. Of two words one edit apart take the one whose prefix ends
at the rarer bigram: its untouched pivot is also in the other's prefix, at the same place when
the edit comes after it, at the same distance from the end when the edit comes before it. That
is the position limit; the text on the pivot's far side is then equal, and so is one half of
the text on the edit's side. A pivot asks under the hash of these equal pieces, a prefix gram
is indexed under them, and pairs that meet are verified by edit distance. So no list of an
index grows with the words that merely share a bigram.

A word's form is its near word of largest count, if that is at least ``ratio`` times its own;
its root is the end of the chain of forms, found by pointer jumping over written tables.

Defined results: a null or empty text has no words, a null id counts as the empty text in the
rule that drops characters; repeated rows count each; ties between forms go to the least word
in code-point order; a word without near words has n_near 0 and is its own root; an empty table
gives no rows; texts of any length are read whole; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODE, _Powers, mix64, slices, stored

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
PREFIX = 3         # q * t + 1 bigrams for t = 1 edit and q = 2
HELD_WORDS = 200_000
WORDS_A_BATCH = 20_000

# One byte a character: A-Z lower-cased, a-z and U+00C0 to U+00FF as they are, all else a blank.
_LETTERS = bytearray(b" " * 256)
for _c in [*range(97, 123), *range(0xC0, 0x100)]:
    _LETTERS[_c] = _c
for _c in range(65, 91):
    _LETTERS[_c] = _c + 32
_LETTERS = bytes(_LETTERS)


def runs(text: str) -> list[bytes]:
    """The text's maximal runs of letters, lower-cased, as Latin-1 (any other character is '?',
    which is no letter)."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def dropped(doc_id: str, run: bytes, every: int | None) -> bytes:
    """``run`` without the character that the rule takes out in this document, if it does."""
    if every is None:
        return run
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str, text_col: str, every: int | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) over all texts, of words of at least ``min_length`` characters. In one of about
    ``every`` pairs of document and run, chosen by crc32, the run loses one character."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("t")).where("t is not null")

    def count(batches):
        import pyarrow as pa
        held: Counter = Counter()

        def emit():
            words = [w.decode("latin-1") for w in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in Counter(runs(text)).items():
                        if len(run) < min_length:
                            continue
                        if every is not None and zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start) % every == 0:
                            run = dropped(doc_id, run, every)
                            if len(run) < min_length:
                                continue
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield emit()
        if held:
            yield emit()

    return src.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The bigrams of a batch of words, one row for each place."""

    def __init__(self, words: list[str]):
        data = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in data], dtype=np.int64)
        self.codes = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        many = np.maximum(self.size - 1, 0)
        self.word = np.repeat(np.arange(len(data)), many)
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.place = np.arange(len(self.word)) - self.first[self.word]
        at = self.off[self.word] + self.place
        self.gram = self.codes[at].astype(np.int32) * 256 + self.codes[np.minimum(at + 1, max(len(self.codes) - 1, 0))] \
            if len(self.codes) else np.zeros(0, dtype=np.int32)
        up, self._down = _Powers.get(len(self.codes) + 1)
        total = np.cumsum(_BYTE_CODE[self.codes] * up[:len(self.codes)])
        self._total = np.concatenate([np.zeros(1, dtype=np.uint64), total])

    def piece(self, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters a to b - 1 of each word."""
        o = self.off[word]
        return mix64((self._total[o + b] - self._total[o + a]) * self._down[o + a] ^ (b - a).astype(np.uint64))

    def prefixes(self, rank: np.ndarray) -> np.ndarray:
        """Rows of the prefix of each word, in order of place."""
        r = rank[self.gram]
        order = np.lexsort((r, self.word))
        last = self.first[:-1] + np.minimum(PREFIX, self.first[1:] - self.first[:-1]) - 1
        bound = r[order][np.maximum(last, 0)] if len(order) else np.zeros(len(self.size), dtype=r.dtype)
        return np.flatnonzero(r <= bound[self.word])


def pivots(places: list[int], weights: list[int]) -> tuple[int, int] | None:
    """Which two of the grams (in order of place) are disjoint and of least total weight: for
    each gram in turn, the best gram that ends before it. None if no two are disjoint."""
    best, pair, lead, seen = None, None, -1, 0
    for j, p in enumerate(places):
        while places[seen] <= p - 2:
            if lead < 0 or weights[seen] < weights[lead]:
                lead = seen
            seen += 1
        if lead >= 0 and (best is None or weights[lead] + weights[j] < best):
            best, pair = weights[lead] + weights[j], (lead, j)
    return pair


def _keys(g: Grams, rows: np.ndarray, change: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) under which the grams ``rows`` meet a gram of a word that is ``change``
    characters longer; the cuts of the text on the edit's side are those of the longer word's
    length, so index rows are made with ``change`` 0."""
    w, p = g.word[rows], g.place[rows]
    n = g.size[w]
    kind = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    out = []
    # the edit comes after the gram: the other word's tail is cut in the middle
    c, zero = p + 2, np.zeros_like(p)
    m = c + (n + change - c) // 2              # in the other word
    ok = (m <= n) & (n + change >= c)          # the tail's first half is equal
    out.append((rows[ok], mix64(g.piece(w[ok], zero[ok], m[ok]) ^ kind[0])))
    s = m - change                             # the second half is equal, and starts here
    ok = (s >= c) & (s <= n) & (n + change >= c)
    out.append((rows[ok], mix64(g.piece(w[ok], zero[ok], c[ok]) ^ kind[1]) + g.piece(w[ok], s[ok], n[ok])))
    # the edit comes before the gram: the other word's head is cut in the middle
    q = p + change                             # the gram's place in the other word
    h = q // 2
    ok = (q >= 0) & (h <= p)                   # the head's first half is equal
    out.append((rows[ok], mix64(g.piece(w[ok], zero[ok], h[ok]) ^ kind[2]) + g.piece(w[ok], p[ok], n[ok])))
    s = h - change                             # the second half is equal, and starts here
    ok = (q >= 0) & (s >= 0) & (s <= p)
    out.append((rows[ok], mix64(g.piece(w[ok], s[ok], n[ok]) ^ kind[3]) + (n - p)[ok].astype(np.uint64)))
    return out


def gram_frequencies(words: DataFrame) -> np.ndarray:
    """For each pair of Latin-1 characters, the places at which words hold it. The alphabet
    bounds the table (90 letters, so 8,100 bigrams), whatever the number of words."""
    def count(batches):
        import pyarrow as pa
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            total += np.bincount(Grams(batch.column(0).to_pylist()).gram, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])
    out = np.zeros(1 << 16, dtype=np.int64)
    for r in words.select("word").mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def _rows(words: DataFrame, frequency: np.ndarray, probing: bool) -> DataFrame:
    """(key, word, n): under the prefix grams, or, ``probing``, under the pivots."""
    rank = np.empty(1 << 16, dtype=np.int32)
    rank[np.lexsort((np.arange(1 << 16), frequency))] = np.arange(1 << 16)

    def make(batches):
        import pyarrow as pa
        for batch in batches:
            for start in range(0, batch.num_rows, WORDS_A_BATCH):
                part = batch.slice(start, WORDS_A_BATCH)
                g = Grams(part.column(0).to_pylist())
                rows = g.prefixes(rank)
                if probing:
                    cut = np.searchsorted(g.word[rows], np.arange(len(g.size) + 1))
                    places, weights = g.place[rows].tolist(), frequency[g.gram[rows]].tolist()
                    chosen = []
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                        two = pivots(places[a:b], weights[a:b])
                        if two:
                            chosen += [a + two[0], a + two[1]]
                    rows = rows[chosen]
                made = [x for change in ((-1, 0, 1) if probing else (0,)) for x in _keys(g, rows, change)]
                at = np.concatenate([g.word[r] for r, _ in made])
                key = np.concatenate([k for _, k in made]).view(np.int64)
                # a word's equal keys, from cuts that fall together, are one
                order = np.lexsort((key, at))
                at, key = at[order], key[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
                at, key = at[new], key[new]
                yield pa.RecordBatch.from_arrays([pa.array(key), *[part.column(i).take(pa.array(at)) for i in (0, 1)]], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(make, "key bigint, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n), a < b: the pairs of ``words`` (word, n) that differ by exactly one
    inserted, deleted or replaced character. Words are distinct and hold two disjoint bigrams
    (four characters) at least."""
    frequency = gram_frequencies(words)
    index = _rows(words, frequency, False).select("key", F.col("word").alias("r"), F.col("n").alias("r_n"))
    probes = _rows(words, frequency, True).select("key", F.col("word").alias("s"), F.col("n").alias("s_n"))
    met = stored(index, "prefix-grams").join(stored(probes, "pivots"), "key") \
        .where((F.col("r") != F.col("s")) & (F.levenshtein("r", "s", 1) == 1))
    swap = F.col("r") > F.col("s")

    def side(a: str, b: str) -> Column:
        return F.when(swap, F.col(a)).otherwise(F.col(b))
    return met.select(side("s", "r").alias("a"), side("r", "s").alias("b"), side("s_n", "r_n").alias("a_n"), side("r_n", "s_n").alias("b_n")) \
              .distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every ``word`` that has a ``form``; counts rise along a chain of forms, so
    none is a circle. Each round doubles the steps that a pointer spans."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return at


def variants(docs: DataFrame, id_col: str, text_col: str, every: int | None = None, min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    if min_length < 4:
        raise ValueError("a word needs two disjoint bigrams: min_length is at least 4")
    words = stored(word_counts(docs, id_col, text_col, every, min_length).where(F.col("n") >= min_count), "words")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")) \
                .union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    near = -F.col("best.m")
    good = F.col("best").isNotNull() & (near >= F.col("n") * ratio)
    judged = stored(words.join(best, "word", "left").select(
        "word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, near).alias("form_n")), "forms")
    return judged.join(roots(judged.where("form is not null")), "word", "left") \
                 .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
