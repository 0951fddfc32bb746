"""TF-IDF index and cosine top-k retrieval (ids F1-F3, H5).

* F1 ``build_index``: the whole document is one unit; uni+bigrams of the index tokens,
  capped vocabulary, L2-normalised weights. The index is a stored table (one row per
  document: its terms, their weights, its norm) that every retrieval reads; the corpus is
  tokenised once.
* F2 cosine similarity = dot product of the normalised vectors.
* F3 top-k per query: similarity descending, ties by higher doc id. There is no similarity
  floor: when fewer than k documents share a term with the query, zero-similarity documents
  fill the list -- those with the highest ids.

Plan: an inverted index in blocks. Up to ``BLOCK`` documents (and ``BLOCK_POSTINGS`` postings) make
a block, stored as one row per term: the positions of its documents in the block and their
weights. A frequent term is thereby split over as many rows as there are blocks. Questions are
turned into blocks the same way, and the two tables meet in an equi-join on the term (salted by
the document block, so a term that every text has is spread over tasks). The joined rows of a
pair of blocks are sorted together and added up, one term after another, into one
``BLOCK`` x ``BLOCK`` matrix, of which only each question's k best go on to the final ranking.
No row is made per (question, document) pair, and neither rows nor matrices pass through the
driver, but for the k ids that pad short lists.

Ranking compares similarities rounded to 9 decimals so float summation order can never
flip the order of two equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import explode_structs, index_tokens
from ..session import stored
from .vocab import Vocabulary, build_vocab, by_number, doc_terms, fit_of_tokens, postings, tfidf

BLOCK = 1024
BLOCK_POSTINGS = 1 << 20
SALTS = 16
RANK_DECIMALS = 9
HEAD = ""  # the row of a block that lists its ids; no term is empty


@dataclass
class Index:
    vocab: Vocabulary
    weighted: DataFrame       # (doc key, terms array<struct<term, tf, w>>, norm), stored
    blocks: DataFrame         # (block, term, pos, w, ids), see ``_transposed``, stored
    key: str
    n_docs: int
    ngram: tuple = (1, 2)

    def postings(self) -> DataFrame:
        return postings(self.weighted, self.key)

    def save(self, path: str) -> None:
        """Write the index as three tables: ``<path>/vocab``, ``/documents`` and ``/blocks``."""
        self.vocab.df.withColumn("n_docs", F.lit(self.n_docs)).write.mode("overwrite").parquet(f"{path}/vocab")
        self.weighted.write.mode("overwrite").parquet(f"{path}/documents")
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")

    @staticmethod
    def load(spark, path: str, ngram=(1, 2)) -> Index:
        weighted = spark.read.parquet(f"{path}/documents")
        n_docs = weighted.count()
        vocab = Vocabulary(spark.read.parquet(f"{path}/vocab"), n_docs)
        return Index(vocab, weighted, spark.read.parquet(f"{path}/blocks"), weighted.columns[0], n_docs, tuple(ngram))


def build_index(docs: DataFrame, key: str, text: str, max_terms: int | None = 5000,
                ngram=(1, 2), tokens=None, block: int = BLOCK) -> Index:
    """tokenise (or count each document's terms) once, stored, fit the vocabulary on that, store
    the weights, by document and by term. An empty corpus gives an index that finds nothing."""
    if max_terms is not None and by_number(tokens, ngram):
        toks = stored(docs.select(key, index_tokens(text).alias("__tok")), "index-tokens")
        n_docs = toks.count()
        vocab = fit_of_tokens(toks, "__tok", n_docs, max_terms, ngram)
        if vocab.rows is not None:
            weighted = stored(vocab.weighed(toks, "__tok", ngram), "index")
            return Index(vocab, weighted, stored(_transposed(weighted, key, block), "index-blocks"), key, n_docs, tuple(ngram))
    counts = stored(doc_terms(docs, key, text, ngram, tokens), "index-counts")
    n_docs = counts.count()
    vocab = Vocabulary(build_vocab(explode_structs(counts, [key], "counts"), n_docs, max_terms), n_docs)
    weighted = stored(vocab.with_weights(counts).drop("counts"), "index")
    blocks = stored(_transposed(weighted, key, block), "index-blocks")
    return Index(vocab, weighted, blocks, key, n_docs, tuple(ngram))


def _cuts(sizes: np.ndarray, block: int) -> list[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``block`` rows and ``BLOCK_POSTINGS`` postings each
    (one row at least)."""
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (i - first == block or held + n > BLOCK_POSTINGS):
            out.append((first, i))
            first, held = i, 0
        held += n
    if len(sizes) > first:
        out.append((first, len(sizes)))
    return out


def _transposed(weighted: DataFrame, key: str, block: int) -> DataFrame:
    """Weighted rows in blocks, by term: (block, term, pos, w, ids). ``pos`` and ``w`` are the
    rows of the block that have the term and their normalised weights; the block's row with
    the term ``HEAD`` has its ids instead, in descending order, which ``pos`` counts from 0."""
    from pyspark.sql.pandas.types import to_arrow_type
    k_type = weighted.schema[key].dataType
    a_type = to_arrow_type(k_type)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, lists, norm = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            sizes = np.diff(np.asarray(lists.offsets))
            for a, b in _cuts(sizes, block):
                order = sorted(range(a, b), key=lambda i: ids[i], reverse=True)
                place = np.empty(b - a, dtype=np.int32)
                place[np.array(order) - a] = np.arange(b - a, dtype=np.int32)
                flat = lists.slice(a, b - a).flatten()
                coded = flat.field("term").dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                w = flat.field("w").to_numpy(zero_copy_only=False) / np.repeat(norm[a:b], sizes[a:b])
                by_term = np.argsort(code, kind="stable")
                ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
                offs = pa.array(np.concatenate([[0, 0], ends]).astype(np.int32))  # HEAD has no postings
                terms = pa.array([HEAD, *coded.dictionary.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(terms), number, dtype=np.int64)), terms,
                    pa.ListArray.from_arrays(offs, pa.array(np.repeat(place, sizes[a:b])[by_term], pa.int32())),
                    pa.ListArray.from_arrays(offs, pa.array(w[by_term], pa.float64())),
                    pa.array([[ids[i] for i in order]] + [None] * (len(terms) - 1), pa.list_(a_type))],
                    names=["block", "term", "pos", "w", "ids"])
                number += 1

    return weighted.select(key, "terms", "norm").mapInArrow(
        run, f"block long, term string, pos array<int>, w array<double>, ids array<{k_type.simpleString()}>")


def _pair_sums(k: int, q_type, d_type):
    """Adds up the rows of each pair of blocks (sorted by pair and term, so a pair's ids come
    first) and yields each question's k best documents with a similarity above zero."""
    def run(batches):
        import pyarrow as pa
        pair = sims = q_ids = d_ids = None

        def best():
            top = np.argsort(-np.round(sims, RANK_DECIMALS), axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(sims, top, axis=1)
            q, j = np.nonzero(score > 0)
            return pa.RecordBatch.from_arrays([pa.array([q_ids[i] for i in q], q_type),
                                               pa.array([d_ids[i] for i in top[q, j]], d_type),
                                               pa.array(score[q, j], pa.float64())], names=["query_id", "doc_id", "sim"])

        for batch in batches:
            q_at, d_at = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            offs = [np.asarray(batch.column(c).offsets) for c in (3, 5)]
            q_pos, q_w, d_pos, d_w = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6))
            for i in range(batch.num_rows):
                if (q_at[i], d_at[i]) != pair:
                    if pair is not None:
                        yield best()
                    pair = (q_at[i], d_at[i])
                    q_ids, d_ids = batch.column(7)[i].as_py(), batch.column(8)[i].as_py()
                    sims = np.zeros((len(q_ids), len(d_ids)))
                    continue
                a, b, c, d = *offs[0][i:i + 2], *offs[1][i:i + 2]
                sims[q_pos[a:b, None], d_pos[c:d]] += q_w[a:b, None] * d_w[c:d]
        if pair is not None:
            yield best()
    return run


def retrieve(queries: DataFrame, qkey: str, qtext: str, index: Index, k: int = 3, block: int = BLOCK) -> DataFrame:
    """F2 + F3: (query_id, rank, doc_id, sim) -- exactly min(k, n_docs) rows per query. Keys
    must not be null; rows with the same query key share one list."""
    from pyspark.sql.pandas.types import to_arrow_type
    if not 1 <= k:
        raise ValueError("k must be positive")
    key = index.key
    q_type, d_type = queries.schema[qkey].dataType, index.weighted.schema[key].dataType
    weights = tfidf(queries, qkey, qtext, index.vocab, index.ngram)
    asked = stored(_transposed(weights, qkey, block), "question-blocks")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    q = asked.select(F.col("block").alias("q_block"), "term", salts.alias("salt"), F.col("pos").alias("q_pos"),
                     F.col("w").alias("q_w"), F.col("ids").alias("q_ids"))
    d = index.blocks.select(F.col("block").alias("d_block"), "term", F.pmod(F.hash("block"), F.lit(SALTS)).alias("salt"),
                            F.col("pos").alias("d_pos"), F.col("w").alias("d_w"), F.col("ids").alias("d_ids"))
    pairs = (q.join(d, ["term", "salt"]).repartition("q_block", "d_block")
             .sortWithinPartitions("q_block", "d_block", "term")
             .select("q_block", "d_block", "term", "q_pos", "q_w", "d_pos", "d_w", "q_ids", "d_ids"))
    hits = pairs.mapInArrow(_pair_sums(k, to_arrow_type(q_type), to_arrow_type(d_type)),
                            f"query_id {q_type.simpleString()}, doc_id {d_type.simpleString()}, sim double")
    # a document without similarity can only be among the k of the highest ids
    pads = [r[0] for r in index.weighted.select(key).orderBy(F.desc(key)).limit(k).collect()]
    ids = F.array(*[F.lit(i) for i in pads]).cast(f"array<{d_type.simpleString()}>")
    padded = asked.where(F.col("term") == HEAD).select(F.explode("ids").alias("query_id")) \
        .select("query_id", F.explode(ids).alias("doc_id"), F.lit(0.0).alias("sim"))
    found = hits.unionByName(padded).groupBy("query_id", "doc_id").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", RANK_DECIMALS)), F.desc("doc_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "sim"))
