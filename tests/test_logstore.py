"""A6 + G2 in one step, A4 that skips unreadable files, A7 over files of several generations."""

import threading

import pytest
from pyspark.sql import functions as F

from textsense.sources import files as IO
from textsense.sources import logstore as S

TURNS = "id long, user_msg string, bot_msg string, sentiment string, score double, sources array<string>"


def turns(spark, ids):
    return spark.createDataFrame([(i, f"q{i}", f"a{i}", "Neutral", 0.0, ["d"]) for i in ids], TURNS)


def ids(spark, root):
    return sorted(r["id"] for r in S.read_log(spark, root).select("id").collect())


def test_append_keeps_the_newest_and_clear_empties(spark, tmp_path):
    root = str(tmp_path / "log")
    assert S.read_log(spark, root) is None
    assert S.append_and_trim(turns(spark, range(1, 8)), root, keep=10) == 0
    before = S.read_log(spark, root)
    S.append_and_trim(turns(spark, range(8, 15)), root, keep=10)
    assert ids(spark, root) == list(range(5, 15))
    assert sorted(r["id"] for r in before.select("id").collect()) == list(range(1, 8))  # an open reader's log stays whole
    for i in range(15, 20):
        S.append_and_trim(turns(spark, [i]), root, keep=10)
    assert ids(spark, root) == list(range(10, 20))
    assert len(list((tmp_path / "log" / "versions").iterdir())) == S.KEPT_VERSIONS
    assert not list((tmp_path / "log" / "parts").glob("[!.]*"))
    S.clear_log(spark, root)
    assert ids(spark, root) == [] and S.read_log(spark, root).columns == list(before.columns)
    S.append_and_trim(turns(spark, [1]), root, keep=10)
    assert ids(spark, root) == [1]


def test_a_failed_append_leaves_no_trace(spark, tmp_path):
    root = str(tmp_path / "log")
    S.append_and_trim(turns(spark, [1, 2]), root)
    bad = turns(spark, [3]).withColumn("bot_msg", F.raise_error(F.lit("scoring failed")).cast("string"))
    with pytest.raises(Exception, match="scoring failed"):
        S.append_and_trim(bad, root)
    assert ids(spark, root) == [1, 2]
    assert len(list((tmp_path / "log" / "versions").iterdir())) == 1
    S.append_and_trim(turns(spark, [3]), root)
    assert ids(spark, root) == [1, 2, 3]


def test_writers_at_a_time_lose_no_append(spark, tmp_path):
    root, errors = str(tmp_path / "log"), []

    def write(i):
        try:
            S.append_and_trim(turns(spark, [i]), root)
        except Exception as exc:  # noqa: BLE001
            errors.append(exc)
    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and ids(spark, root) == [0, 1, 2, 3]


def test_a_taken_number_makes_the_writer_start_again(spark, tmp_path, monkeypatch):
    root, publish = str(tmp_path / "log"), S._Folder.publish
    S.append_and_trim(turns(spark, [1]), root)

    def other_writer_first(self, name, content):
        monkeypatch.setattr(S._Folder, "publish", publish)
        S.append_and_trim(turns(spark, [2]), root)
        return self.publish(name, content)
    monkeypatch.setattr(S._Folder, "publish", other_writer_first)
    assert S.append_and_trim(turns(spark, [3]), root) == 2
    assert ids(spark, root) == [1, 2, 3]
    assert len(list((tmp_path / "log" / "versions").iterdir())) == 3


def test_unreadable_files_are_skipped_and_named(spark, tmp_path):
    (tmp_path / "good.txt").write_text("  été \n", encoding="utf-8")
    (tmp_path / "broken.MD").write_bytes(b"caf\xe9 au lait")
    (tmp_path / "cut.txt").write_bytes("é".encode()[:1])
    (tmp_path / "empty.txt").write_bytes(b" \n")
    (tmp_path / "other.csv").write_bytes(b"\xff")
    docs, skipped = IO.read_documents_strict(spark, str(tmp_path))
    assert [tuple(r) for r in docs.collect()] == [("good.txt", "été")]
    assert sorted(tuple(r) for r in skipped.collect()) == [("broken.MD", "not UTF-8"), ("cut.txt", "not UTF-8")]


def test_log_files_of_several_generations_read_as_one(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1, "q", "a")], "id long, user_msg string, bot_msg string").write.parquet(path)
    IO.append_turns(turns(spark, [2]), path)
    rows = IO.read_chat_log(spark, path).collect()
    assert [(r["id"], r["sentiment"], r["sources"]) for r in rows] == [(1, None, []), (2, "Neutral", ["d"])]
