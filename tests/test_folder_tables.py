"""Queries over tables that are a folder of files, as large tables are."""

from textsense.plans.stream_queries import QUERIES

DOCS = [(i, f"rewh word{i}" if i % 2 else "nicht rewh", "en", "s", 9) for i in range(20)]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = [(c, t, "user" if t % 2 else "assistant", f"rewh {c} {t}") for c in range(6) for t in range(1, 5)]
TURN_SCHEMA = "conv_id long, turn long, role string, text string"


def _write(spark, path, docs, turns):
    spark.createDataFrame(docs, DOC_SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(turns, TURN_SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_streams_read_every_file_of_a_folder(spark, tmp_path):
    sf = _write(spark, tmp_path, DOCS, TURNS)
    scored = {r["doc_id"]: r["polarity"] for r in QUERIES["stream_score"](spark, sf).collect()}
    assert set(scored) == set(range(20)) and scored[1] > 0
    log = QUERIES["stream_log"](spark, sf).collect()
    assert sorted((r["conv_id"], r["turn"]) for r in log) == [(c, t) for c in range(6) for t in (1, 3)]


def test_streams_over_empty_tables(spark, tmp_path):
    sf = _write(spark, tmp_path, [], [])
    assert QUERIES["stream_score"](spark, sf).collect() == []
    assert QUERIES["stream_log"](spark, sf).collect() == []


def test_knowledge_base_files_are_bounded(spark, tmp_path, monkeypatch):
    """One large scan split must not become one file, which is read as a single value."""
    from textsense.plans import io_queries as Q
    docs = [(i, f"word{i} x", "en", "s", 9) for i in range(2 * Q.FILE_RECORDS + 7)]
    spark.createDataFrame(docs, DOC_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TURNS, TURN_SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    seen = []
    read = Q.IO.read_documents
    monkeypatch.setattr(Q.IO, "read_documents", lambda s, path: seen.append(path) or read(s, path))
    got = Q.QUERIES["files_roundtrip"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(sum(len(d[1]) - 1 for d in docs), 12, 0)]
    lines = [r[0].count("\n") for r in spark.read.text(seen[0], wholetext=True).collect()]
    assert sum(lines) == len(docs) and max(lines) <= Q.FILE_RECORDS
