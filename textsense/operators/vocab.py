"""Term counts, vocabulary and TF-IDF weights (ids C12, E1-E5).

Semantics (the defaults of the TF-IDF vectoriser the reference calls):

* E1 term frequency = raw count of a term in a document; document frequency = documents
  holding the term;
* E2 vocabulary = the ``max_terms`` terms with the highest total count over the corpus
  (ties: term ascending);
* E3 idf = ln((1 + n_docs) / (1 + df)) + 1;
* E4 weight = tf * idf, L2-normalised over the document's vocabulary terms;
* E5 transforming unseen text uses the fitted vocabulary/idf only; unknown terms vanish.

Physical plan: a document's terms are counted in place (sort the term array, measure the
runs), so (doc, term, tf) rows come out of a narrow explode with no shuffle. A capped vocabulary of
words and word pairs comes from two aggregations of Arrow slices' totals: of all words, then of the
pairs of words that occur as often as the last word within the cap. A pair does not occur more
often than either of its words, so no other pair can be in the vocabulary. Any other vocabulary is
one aggregation over the (doc, term, tf) rows. A vocabulary of at most
``MAX_LITERAL_ROWS`` terms (any capped one) is embedded as a constant lookup, so weights and
norms are again computed per document with no join and no shuffle; a larger, uncapped one is
a stored table that the documents' terms are joined with. Both give the same weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.lookup import LookupTable
from ..session import MAX_LITERAL_ROWS, few_rows, stored


def with_term_counts(df: DataFrame, terms: str, out: str = "counts") -> DataFrame:
    """Adds ``out`` = array<struct<term, tf>>: the distinct terms of ``terms`` with their
    counts, in term order. Sorting (``sort_array``, natural order) is O(n log n) in the JVM;
    a run starts where a term differs from its predecessor. The sorted array and the run
    starts are materialised as their own columns so each is computed once per row."""
    return (df.withColumn("__s", F.sort_array(F.col(terms)))
              .withColumn("__st", F.filter(
                  F.transform("__s", lambda x, i: F.when((i == 0) | (x != F.get(F.col("__s"), i - 1)), i)),
                  lambda i: i.isNotNull()))
              .withColumn(out, F.transform("__st", lambda st, j: F.struct(
                  F.get(F.col("__s"), st).alias("term"),
                  (F.coalesce(F.get(F.col("__st"), j + 1), F.size("__s")) - st).cast("long").alias("tf"))))
              .drop("__s", "__st"))


def doc_terms(df: DataFrame, key: str, text: str, ngram=(1, 2), tokens=None) -> DataFrame:
    """(key, counts array<struct<term, tf>>): C11 tokens (or ``tokens``), n-grams, counts."""
    toks = tokens if tokens is not None else T.index_tokens(text)
    # tokens are materialised once: every n-gram reads its neighbours from the array
    d = df.select(key, toks.alias("__tok")).select(key, T.ngrams(F.col("__tok"), *ngram).alias("__terms"))
    return with_term_counts(d, "__terms").select(key, "counts")


def term_counts(df: DataFrame, key: str, text: str, ngram=(1, 2), tokens=None) -> DataFrame:
    """(key, term, tf) -- narrow, no shuffle."""
    return T.explode_structs(doc_terms(df, key, text, ngram, tokens), [key], "counts")


def build_vocab(counts: DataFrame, n_docs: int, max_terms: int | None = 5000) -> DataFrame:
    """E2 + E3 from (key, term, tf) rows: (term, total_tf, df, idf) for the kept terms."""
    return kept_terms(counts.groupBy("term").agg(F.sum("tf").alias("total_tf"), F.count(F.lit(1)).alias("df")), n_docs, max_terms)


def kept_terms(v: DataFrame, n_docs: int, max_terms: int | None = 5000) -> DataFrame:
    """E2 + E3 from (term, total_tf, df)."""
    if max_terms is not None:
        v = v.orderBy(F.desc("total_tf"), F.asc("term")).limit(max_terms)
    return v.withColumn("idf", F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.col("df") + 1.0)) + 1.0)


SLICE_TOKENS = 1 << 20  # tokens that are counted at a time (a text is not cut)


def _slices(lists):
    """The texts' tokens of an Arrow batch, a bounded slice at a time: for each, its first and last
    text (exclusive), the code of each token in the slice's dictionary, the dictionary, and the
    text of each token, from 0. Null tokens are left out."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(lengths), 0
    while a < len(lists):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, side="right")))
        coded = lists.slice(a, b - a).flatten().dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(b - a), lengths[a:b])
        yield a, b, code[code >= 0], coded.dictionary, doc[code >= 0]
        a = b


def _totals(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, ascending: how often each occurs, and in how many texts."""
    u, at, tf = np.unique(code, return_inverse=True, return_counts=True)
    df = np.bincount(np.unique(doc * max(len(u), 1) + at) % max(len(u), 1), minlength=len(u)) if len(u) else tf
    return u, tf.astype(np.int64), df.astype(np.int64)


def word_totals(tokens: DataFrame, col: str) -> DataFrame:
    """(term, total_tf, df) of all tokens of an array column."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for _, _, code, words, doc in _slices(batch.column(0)):
                u, tf, df = _totals(doc, code)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(u)), pa.array(tf), pa.array(df)], names=["term", "tf", "df"])
    return (tokens.select(col).mapInArrow(run, "term string, tf long, df long").groupBy("term")
            .agg(F.sum("tf").alias("total_tf"), F.sum("df").alias("df")))


def _pair_totals(tokens: DataFrame, col: str, words: list[str], least: int) -> DataFrame:
    """(term, total_tf, df) of the pairs of neighbours among ``words`` that occur ``least`` times."""
    held = tokens.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        known = pa.array(held.value, pa.string())
        for batch in batches:
            for _, _, code, dictionary, doc in _slices(batch.column(0)):
                word = pc.index_in(dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
                both = (word[:-1] >= 0) & (word[1:] >= 0) & (doc[:-1] == doc[1:])
                u, tf, df = _totals(doc[:-1][both], (word[:-1] * len(known) + word[1:])[both])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(tf), pa.array(df)], names=["pair", "tf", "df"])

    def named(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        known = pa.array(held.value, pa.string())
        for batch in batches:
            pair = batch.column(0).to_numpy()
            first, second = (known.take(pa.array(x)) for x in (pair // len(known), pair % len(known)))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, second, " "), batch.column(1), batch.column(2)],
                                             names=["term", "total_tf", "df"])
    pairs = (tokens.select(col).mapInArrow(run, "pair long, tf long, df long").groupBy("pair")
             .agg(F.sum("tf").alias("total_tf"), F.sum("df").alias("df")).where(F.col("total_tf") >= least))
    return pairs.mapInArrow(named, "term string, total_tf long, df long")


def top_totals(tokens: DataFrame, col: str, max_terms: int, ngram=(1, 2)) -> DataFrame | None:
    """(term, total_tf, df) of all words, or words and pairs, that can be among the ``max_terms``
    most frequent; None if too many words are as frequent as that (count all terms then). ``tokens``
    is read several times; its tokens hold no blank."""
    words = word_totals(tokens, col)
    if tuple(ngram) == (1, 1):
        return words
    words = stored(words, "word-totals")
    last = words.orderBy(F.desc("total_tf")).limit(max_terms).agg(F.min("total_tf").alias("m"), F.count(F.lit(1)).alias("n")).first()
    least = last["m"] if last["n"] >= max_terms else 1
    words = words.where(F.col("total_tf") >= least)
    often = few_rows(words.select("term"))
    if often is None:
        return None
    return words.unionByName(_pair_totals(tokens, col, [r["term"] for r in often], least)) if often else words


class Vocabulary:
    """A fitted vocabulary: terms, idf, and a lookup term -> (term_id, idf) if it is small
    (term_id is null in a larger one)."""

    def __init__(self, vocab: DataFrame, n_docs: int, max_rows: int | None = None):
        self.n_docs = n_docs
        vocab = stored(vocab.select("term", "total_tf", "df", "idf"), "vocabulary")
        rows = few_rows(vocab, MAX_LITERAL_ROWS if max_rows is None else max_rows)
        if rows is None:
            self.df = vocab.select("term", F.lit(None).cast("int").alias("term_id"), "total_tf", "df", "idf")
            self.table, self.size, self.rows = None, vocab.count(), None
            return
        # small: number the terms in term order (the vectoriser's feature order)
        rows = sorted(rows, key=lambda r: r["term"].encode("utf-8"))
        self.rows = [(r["term"], float(r["idf"])) for r in rows]
        spark = vocab.sparkSession
        self.df = spark.createDataFrame(
            [(r["term"], i, int(r["total_tf"]), int(r["df"]), float(r["idf"])) for i, r in enumerate(rows)],
            "term string, term_id int, total_tf long, df long, idf double")
        self.table = LookupTable(self.df, "term", ["term_id", "idf"], what="vocabulary")
        self.size = self.table.size

    def weights(self, counts) -> Column:
        """E4/E5 on a counts array: array<struct<term, tf, weight>> of the known terms,
        L2-normalised. Unknown terms are dropped; no known term -> empty array."""
        counts = F.col(counts) if isinstance(counts, str) else counts
        known = F.filter(F.transform(counts, lambda c: F.struct(
            c["term"].alias("term"), c["tf"].alias("tf"),
            (c["tf"] * self.table.get(c["term"])["idf"]).alias("w"))), lambda c: c["w"].isNotNull())
        return known

    def with_weights(self, df: DataFrame, counts: str = "counts", out: str = "terms") -> DataFrame:
        """Adds ``out`` = array<struct<term, tf, w>> (w = tf * idf, known terms only) and
        ``norm`` = the L2 norm of the w's; ``postings`` divides after the explode.

        (Dividing inside the array would reference ``norm`` once, inside a lambda, and
        Catalyst would inline its whole aggregate into every element.)"""
        if self.table is None:
            df = self._joined(df, counts, out)
        else:
            df = df.withColumn(out, self.weights(counts))
        return df.withColumn("norm", F.sqrt(F.aggregate(out, F.lit(0.0), lambda a, c: a + c["w"] * c["w"])))

    def weighed(self, df: DataFrame, tokens: str, ngram=(1, 2), out: str = "terms") -> DataFrame:
        """``with_weights`` from an array of tokens without blanks, for a vocabulary that is held
        as a literal: known words and pairs are looked up by number and counted, a slice of
        texts at a time."""
        held = df.sparkSession.sparkContext.broadcast(self.rows)
        keep = [c for c in df.columns if c != tokens]
        pairs_too, words_too = ngram[1] == 2, ngram[0] == 1

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc
            n = max(len(held.value), 1)
            terms = pa.array([t for t, _ in held.value], pa.string())
            idf = np.array([i for _, i in held.value] or [0.0])
            split = [t.split(" ") for t, _ in held.value]
            known = pa.array(sorted({w for x in split for w in x if len(x) <= 2}), pa.string())
            number = {w: i for i, w in enumerate(known.to_pylist())}
            of_word = np.full(len(known) + 1, -1, dtype=np.int64)  # the last one: unknown words
            for i, x in enumerate(split):
                if len(x) == 1 and words_too:
                    of_word[number[x[0]]] = i
            of_pair = sorted((number[x[0]] * len(known) + number[x[1]], i) for i, x in enumerate(split) if len(x) == 2 and pairs_too)
            pair, pair_term = np.array(of_pair, dtype=np.int64).reshape(-1, 2).T
            for batch in batches:
                for a, b, code, dictionary, doc in _slices(batch.column(len(keep))):
                    word = pc.index_in(dictionary, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False).astype(np.int64)[code]
                    term = of_word[word]
                    found = [(doc * n + term)[term >= 0]]
                    if len(pair):
                        both = (word[:-1] < len(known)) & (word[1:] < len(known)) & (doc[:-1] == doc[1:])
                        asked, where = (word[:-1] * len(known) + word[1:])[both], doc[:-1][both]
                        at = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
                        hit = pair[at] == asked
                        found.append(where[hit] * n + pair_term[at[hit]])
                    u, tf = np.unique(np.concatenate(found), return_counts=True)
                    w = tf * idf[u % n]
                    offs = pa.array(np.searchsorted(u, np.arange(b - a + 1) * n).astype(np.int32))
                    made = pa.StructArray.from_arrays([terms.take(pa.array(u % n)), pa.array(tf.astype(np.int64)), pa.array(w)],
                                                      names=["term", "tf", "w"])
                    norm = np.sqrt(np.bincount(u // n, weights=w * w, minlength=b - a))  # adds up in term order
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(keep))],
                                                      pa.ListArray.from_arrays(offs, made), pa.array(norm)], names=[*keep, out, "norm"])

        types = dict(df.dtypes)
        return df.select(*keep, tokens).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"`{out}` array<struct<term:string,tf:bigint,w:double>>", "norm double"]))

    def _joined(self, df: DataFrame, counts: str, out: str) -> DataFrame:
        """The weights of a large vocabulary: a document's distinct terms are joined with it
        and gathered back, in term order."""
        base = stored(df.withColumn("__uid", F.monotonically_increasing_id()), "term-counts")
        rows = T.explode_structs(base, ["__uid"], counts).join(self.df.select("term", "idf"), "term")
        found = rows.groupBy("__uid").agg(F.array_sort(F.collect_list(F.struct(
            "term", "tf", (F.col("tf") * F.col("idf")).alias("w")))).alias(out))
        empty = F.array().cast("array<struct<term:string,tf:bigint,w:double>>")
        return base.join(found, "__uid", "left").withColumn(out, F.coalesce(out, empty)).drop("__uid")


def by_number(tokens, ngram) -> bool:
    """Whether terms can be counted by their words' numbers: index tokens (they hold no blank),
    words or words and pairs."""
    return tokens is None and tuple(ngram) in ((1, 1), (1, 2))


def fit_of_tokens(tokens: DataFrame, col: str, n_docs: int, max_terms: int, ngram=(1, 2)) -> Vocabulary:
    """E1-E3 over a stored table of index tokens."""
    totals = top_totals(tokens, col, max_terms, ngram)
    if totals is None:
        counts = term_counts(tokens.withColumn("__row", F.monotonically_increasing_id()), "__row", None, ngram, F.col(col))
        return Vocabulary(build_vocab(counts, n_docs, max_terms), n_docs)
    return Vocabulary(kept_terms(totals, n_docs, max_terms), n_docs)


def fit_vocabulary(docs: DataFrame, key: str, text: str, max_terms: int | None = 5000, ngram=(1, 2),
                   tokens=None) -> Vocabulary:
    """E1-E3 over a corpus; its tokens are stored if they are read more than once."""
    if max_terms is not None and by_number(tokens, ngram):
        toks = stored(docs.select(T.index_tokens(text).alias("__tok")), "tokens")
        return fit_of_tokens(toks, "__tok", toks.count(), max_terms, ngram)
    n_docs = docs.count()
    counts = term_counts(docs, key, text, ngram, tokens)
    return Vocabulary(build_vocab(counts, n_docs, max_terms), n_docs)


def tfidf(docs: DataFrame, key: str, text: str, vocab: Vocabulary, ngram=(1, 2), tokens=None,
          keep: list[str] | None = None) -> DataFrame:
    """(key, [keep...], terms array<struct<term, tf, w>>, norm) for any texts."""
    keep = keep or []
    toks = tokens if tokens is not None else T.index_tokens(text)
    d = docs.select(key, *keep, toks.alias("__tok"))
    if vocab.rows is not None and by_number(tokens, ngram):
        return vocab.weighed(d, "__tok", ngram)
    d = d.select(key, *keep, T.ngrams(F.col("__tok"), *ngram).alias("__terms"))
    d = with_term_counts(d, "__terms").drop("__terms")
    return vocab.with_weights(d).drop("counts")


def postings(weighted: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """(key, term, tf, weight) rows from the per-document weight arrays (narrow explode),
    weights L2-normalised per document."""
    rows = T.explode_structs(weighted, [key, *(keep or []), "norm"], "terms")
    return rows.select(key, *(keep or []), "term", "tf", (F.col("w") / F.col("norm")).alias("weight"))
