import hashlib
import random
import re

import pytest

from textsense.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, n=13):
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            k = min(n, len(v))
            wins = {tuple(v[a:a + k]) for a in range(len(v) - k + 1)} if v else set()
            for a in range(len(w) - k + 1):
                if k and tuple(w[a:a + k]) in wins:
                    hit.update(range(a, a + k))
                    if item is not None:
                        found.add(item)
        ids = sorted(map(str, found))
        out.append((i, len(w), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    vocab = "the of And TO été ßa 中文 i'm x1 a-b Ünder".split()
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(10, say(20)), (2, say(14)), (3, "short Item"), (4, ""), (5, None), (None, say(16)), (2, say(15)), (6, "solo")]
    items.append(items[0])
    docs = [(k, say(rng.randrange(60)) + " " + (rng.choice(items)[1] or "") + "! " + say(rng.randrange(30))) for k in range(60)]
    docs += [(1, None), (2, ""), (None, items[0][1]), (1, items[1][1].upper()), (99, (say(5000) + " " + items[0][1]))]
    return docs, items


@pytest.mark.parametrize("bound", [D.MAX_WINDOWS, 0])
def test_report_equals_brute_force(spark, texts, bound):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.report(texts(docs), "doc_id", "text", bench, "item_id", "text", max_windows=bound).collect()
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got], key=repr)
    assert got == brute(docs, items)


def test_remove_documents_and_spans(spark, texts):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = texts(docs)
    kept = D.remove_documents(df, "text", bench, "item_id", "text")
    assert kept.columns == df.columns
    clean = [x for x in brute(docs, items) if not x[4]]
    assert sorted(map(repr, [r["doc_id"] for r in kept.collect()])) == sorted(repr(x[0]) for x in clean)
    cut = D.remove_spans(df, "text", bench, "item_id", "text")
    left = {(r["doc_id"], len(split(r["text"]))) for r in cut.collect()}
    assert left == {(x[0], x[1] - x[2]) for x in brute(docs, items)}


def test_ascii_lower(spark):
    rows = ["ABCÉxΣ Ⓐ", "plain", "İSTANBUL", "", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(D.ascii_lower(D.F.col("t"))).collect()
    assert [r[0] for r in got] == [None if r is None else r.translate(LOWER) for r in rows]


def test_empty_tables(spark, texts):
    none = spark.createDataFrame([], "item_id bigint, text string")
    r = D.report(texts([(1, "a b")]), "doc_id", "text", none, "item_id", "text").first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (2, 0, False)
    assert D.report(texts([]), "doc_id", "text", none, "item_id", "text").count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_only_a_to_z_change_case(spark):
    from pyspark.sql import functions as F
    points = [c for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"A{chr(c)}z") for c in points], "c int, t string")
    wrong = rows.where(D.ascii_lower(F.col("t")) != F.translate("t", D._UPPER, D._LOWER)).collect()
    assert wrong == []


def test_many_items_of_one_window_are_not_sent_along(spark, texts, monkeypatch):
    docs, items = texts([(1, "some short text here"), (2, "nothing")]), spark.createDataFrame([(i, "short text") for i in range(40)], "item_id long, text string")
    got = []
    for most in (50, 20):
        taken = []
        monkeypatch.setattr(D, "_hits_in_row", lambda w, rows, f=D._hits_in_row: taken.append(len(rows)) or f(w, rows))
        got.append(sorted((r["doc_id"], r["n_hit"], len(r["items"])) for r in D.report(docs, "doc_id", "text", items, "item_id", "text", max_windows=most).collect()))
        monkeypatch.undo()
        assert bool(taken) == (most == 50)
    assert got[0] == got[1] == [(1, 2, 40), (2, 0, 0)]
