"""What workers and Arrow batches hold beside an executor's heap stays small."""

import pytest

from textsense.llm import common, forest_join, trie_bpe
from textsense.llm.queries import tokenizer_path

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def default_batches(spark):
    spark.conf.unset(BATCH)
    yield
    spark.conf.unset(BATCH)


def test_the_join_hands_small_batches_to_python(spark, default_batches):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 300) as text")
    assert forest_join.classes(docs, "doc_id", "text").count() == 3000

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])
    got = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 3 << 20


def test_a_callers_batch_size_is_left_alone(spark, default_batches):
    spark.conf.set(BATCH, "5m")
    common.small_batches(spark)
    assert spark.conf.get(BATCH) == "5m"


def test_spare_codec_gives_the_same_and_leaves_nothing(spark, texts, edge_rows, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    want = trie_bpe.encode_and_decode(texts(edge_rows), "text", path).select("doc_id", "ids", "decoded").collect()
    got = trie_bpe.encode_and_decode(texts(edge_rows), "text", path, spare=True).select("doc_id", "ids", "decoded").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    made = []
    monkeypatch.setattr(trie_bpe, "append_columns", lambda df, col, make, fields: made.append(make))
    monkeypatch.setattr(trie_bpe.Codec, "_loaded", {})
    trie_bpe.encode_and_decode(None, "text", path, spare=True)
    assert [len(x) for x in made[0]()(["one two", None])] == [2, 2] and trie_bpe.Codec._loaded == {}
