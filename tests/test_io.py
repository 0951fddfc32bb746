"""Readers and writers on files written by the test."""

import pytest

from textsense.operators import chatlog as C
from textsense.sources import files as IO


def test_read_documents(spark, tmp_path):
    kb = tmp_path / "kb"
    kb.mkdir()
    (kb / "b.TXT").write_text("  second doc \n\n", encoding="utf-8")
    (kb / "a.md").write_text("# first\nline", encoding="utf-8")
    (kb / "empty.txt").write_text(" \n\t", encoding="utf-8")
    (kb / "skip.csv").write_text("x,y", encoding="utf-8")
    (kb / "sub").mkdir()
    (kb / "sub" / "deep.txt").write_text("not read", encoding="utf-8")
    got = [(r["id"], r["text"]) for r in IO.read_documents(spark, str(kb)).orderBy("id").collect()]
    assert got == [("a.md", "# first\nline"), ("b.TXT", "second doc")]


def test_csv_latin1_roundtrip_and_required_columns(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes('Tweet,n\n"caf\xe9, ""quoted""\nline",1\nplain,2\n'.encode("latin-1"))
    df = IO.read_csv_text(spark, str(p))
    rows = sorted((r["Tweet"], r["n"]) for r in df.collect())
    assert rows == [('café, "quoted"\nline', 1), ("plain", 2)]
    IO.require_columns(df, ["Tweet"])
    with pytest.raises(IO.SourceError):
        IO.require_columns(df, ["text"])
    with pytest.raises(IO.SourceError):
        IO.read_csv_text(spark, str(tmp_path / "missing.csv"))
    out = tmp_path / "out"
    IO.write_scored(df, str(out))
    back = IO.read_csv_text(spark, str(out), encoding="UTF-8")
    assert sorted((r["Tweet"], r["n"]) for r in back.collect()) == rows


def test_chat_log_append_recent_clear(spark, tmp_path):
    path = str(tmp_path / "log")
    turns = spark.createDataFrame([(i, f"q{i}", f"a{i}", "Neutral 😐", 0.0, None if i % 2 else ["d1"])
                                   for i in range(1, 251)],
                                  "id long, user_msg string, bot_msg string, sentiment string, score double, "
                                  "sources array<string>")
    IO.append_turns(turns, path)
    recent = IO.read_chat_log(spark, path, 200).collect()
    assert len(recent) == 200 and recent[0]["id"] == 51 and recent[-1]["id"] == 250
    assert "created_at" not in recent[0].asDict()
    assert {tuple(r["sources"]) for r in recent} == {(), ("d1",)}
    IO.clear_chat_log(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_missing_column_migration(spark):
    df = spark.createDataFrame([(1, "q")], "id long, user_msg string")
    out = C.with_missing_columns(df, "id long, user_msg string, sources string")
    assert out.columns == ["id", "user_msg", "sources"] and out.first()["sources"] is None


def test_pairing_and_retention(spark):
    msgs = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
                                  (1, 3, "user", "q2"), (1, 4, "user", "q3"), (1, 5, "assistant", "a3")],
                                 "conv_id long, turn long, role string, text string")
    pairs = {(r["turn"], r["user_msg"], r["bot_msg"]) for r in C.pair_turns(msgs).collect()}
    assert pairs == {(1, "q1", "a1"), (4, "q3", "a3")}
    newest = C.keep_newest(msgs, ["turn"], 2, by="conv_id")
    assert sorted(r["turn"] for r in newest.collect()) == [4, 5]
    log = C.message_log(C.pair_turns(msgs)).orderBy("turn").collect()
    assert [(r["turn"], r["role"]) for r in log] == [(1, "user"), (2, "assistant"), (4, "user"), (5, "assistant")]


def test_csv_keeps_blanks_and_empty_texts(spark, tmp_path):
    rows = [(1, " lead and trail "), (2, ""), (3, None), (4, "a,b"), (5, "  "), (6, '"q"'), (7, "line\nbreak ")]
    df = spark.createDataFrame(rows, "id long, t string")
    IO.write_scored(df, str(tmp_path / "out"))
    back = IO.read_csv_text(spark, str(tmp_path / "out"), encoding="UTF-8", schema="id long, t string")
    assert sorted((r["id"], r["t"]) for r in back.collect()) == rows


def test_append_time_is_utc_whatever_the_zone(spark, tmp_path, monkeypatch):
    import datetime as dt
    import time
    turns = spark.createDataFrame([(1, "q", "a", "n", 0.0, ["d"])],
                                  "id long, user_msg string, bot_msg string, sentiment string, score double, sources array<string>")
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        IO.append_turns(turns, str(tmp_path / "log"), now=dt.datetime(2024, 3, 1, 12, 0, 0))
        micros = spark.read.parquet(str(tmp_path / "log")).selectExpr("unix_micros(created_at)").first()[0]
    finally:
        monkeypatch.undo()
        time.tzset()
    assert micros == 1709294400 * 1_000_000


def test_pairs_over_gaps_repeats_and_spans(spark):
    import random
    schema = "conv_id long, turn long, role string, text string"
    rnd = random.Random(11)
    rows = [(1, 0, "user", "q"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 9, "user", "q9"),
            (1, 40, "system", "s"), (1, 41, "assistant", "late"), (2, 5, "assistant", "a5"), (2, 5, "user", "q5"),
            (2, -7, "user", "before"), (2, 4, "assistant", "its reply"), (None, 1, "user", "x"), (3, None, "user", "y"),
            (4, 3, "user", None), (4, 70, "assistant", "to nothing")]
    t = 0
    for _ in range(300):  # one long conversation with random gaps, over many spans
        t += rnd.choice([1, 1, 2, 15])
        rows.append((9, t, rnd.choice(["user", "assistant", "system"]), f"m{t}"))
    order = {"user": 0, "assistant": 1}
    want = set()
    for c in (1, 2, 3, 4, 9):
        seq = sorted({r for r in rows if r[0] == c and r[1] is not None}, key=lambda r: (r[1], order.get(r[2], 2), r[3] or ""))
        want |= {(c, a[1], a[3], b[3], b[1]) for a, b in zip(seq, seq[1:]) if a[2] == "user" and b[2] == "assistant"}
    df = spark.createDataFrame(rows, schema).repartition(3)
    for span in (8, C.SPAN):
        got = [tuple(r) for r in C.pair_next_turns(df, span=span).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (1, 0, "q", "a", 2) in want and (2, 5, "q5", "a5", 5) in want and (2, -7, "before", "its reply", 4) in want
    log = C.message_log(C.pair_next_turns(df.where("conv_id = 1"))).collect()
    assert sorted((r["turn"], r["role"]) for r in log) == [(0, "user"), (2, "assistant")]
    assert C.pair_next_turns(df.limit(0)).count() == 0


def test_pairs_equal_the_plain_join_on_consecutive_turns(spark):
    rows = [(c, t, r, f"{c}-{t}") for c in range(20) for t, r in enumerate(["system", "user", "assistant", "user", "user", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = sorted(C.pair_turns(df).select("conv_id", "turn", "user_msg", "bot_msg").collect())
    assert sorted(C.pair_next_turns(df, span=4).drop("reply_turn").collect()) == plain and len(plain) == 40
