import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from textsense.llm import forest_join
from textsense.llm.common import HashFilter, stored
from textsense.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    assert [n for n, _ in P.STAGES] == ["quality rules", "quality classifier", "n-gram Jaccard join", "benchmark decontamination",
                                        "BPE encoding and decoding"]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stored(stage(spark, docs, SF), "stage")
        kept.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 0:  # the rules' query keeps the same rows
            ids = {r["doc_id"] for r in QUERIES["op2_quality_rules"](spark, SF).where("kept").collect()}
            assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k == 2:
            left = forest_join.classes(docs, "doc_id", "text")
            assert left.where("n_links > 0").count() == 0
    assert kept == sorted(kept, reverse=True) and kept[-1] > kept[0] * 0.5
    assert docs.where("not round_trip or n_tokens * 4 <> octet_length(ids)").count() == 0


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_edge_rows_pass_without_error(spark, texts, edge_rows):
    docs = texts(edge_rows)
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stored(stage(spark, docs, SF), "stage")
        assert k == 4 or docs.columns == columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_hash_filter(spark):
    few = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("h"))
    df = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    f = HashFilter(few, "h")
    inside, rest = f.rows(df, "h", True), f.rows(df, "h", False)
    assert {r["id"] for r in inside.collect()} >= set(range(0, 3000, 7))
    assert inside.count() + rest.count() == 3000 and rest.count() > 2000
    assert HashFilter(few.limit(0), "h").rows(df, "h", True).count() == 0
