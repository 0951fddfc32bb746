"""The corpus pipeline: five stages over documents, each calling one operator of textsense.llm.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
frame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``; a stage works on all rows that its predecessor kept, and
the rows it rejects are gone. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsense.llm import decontaminate, forest_join, fourier_quality, quality_rules, trie_bpe
from textsense.llm.common import read_table, small_batches, stored
from textsense.llm.queries import tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or diverge from their language's usual text go."""
    return quality_rules.keep(docs, "text", "lang")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated quality score under one half go."""
    small_batches(spark)
    return fourier_quality.keep_good(docs, "doc_id", "text", read_table(spark, sf_dir, "labels"), "doc_id", "quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id."""
    return forest_join.keep_one(docs, "doc_id", "text")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside benchmark windows go."""
    return decontaminate.remove_documents(docs, "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit), and whether they decode to
    its text."""
    small_batches(spark)
    docs = docs.select("doc_id", "lang", "source", "text")
    coded = trie_bpe.encode_and_decode(docs, "text", tokenizer_path("byte_bpe_50k.json"), spare=True)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe),
]

#: No SQL: the classifier is trained here, and the last stage runs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
