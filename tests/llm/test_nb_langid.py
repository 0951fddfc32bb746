import zlib

import numpy as np

from textsense.llm import nb_langid as N
from textsense.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_nb_langid"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_counts_and_probabilities_equal_brute_force(spark):
    rows = [("aab ab", "x"), ("bba", "y"), ("ab", "y"), ("12 3", "y"), (None, "x"), ("zz", None), ("ÄB", "x")]
    [m] = N.train(spark.createDataFrame(rows, "t string, l string"), "t", "l").parts()
    assert m.languages == ["x", "y"] and np.allclose(m.log_prior, np.log([0.5, 0.5]))
    table = np.full((1 << N.BUCKET_BITS, 2), N.SMOOTHING)
    for t, lang in rows:
        if t and lang and any(c.isalpha() for c in t):
            t = t.lower()
            for n in N.ORDERS:
                for i in range(len(t) - n + 1):
                    # the bucket of one n-gram is the last one of the text that ends with it
                    b = N.buckets(t[i:i + n])
                    table[b[-1], "xy".index(lang)] += 1
    assert np.allclose(m.log_prob, np.log(table / table.sum(axis=0)), atol=1e-5)


def test_pieces_of_a_text_count_the_same(monkeypatch):
    text = "Some text, çà et là. " * 30
    whole = np.bincount(N.buckets(text.lower()), minlength=1 << N.BUCKET_BITS)
    for size in (1, 2, 7, 100, len(text)):
        monkeypatch.setattr(N, "PIECE", size)
        assert (N.counts(text) == whole).all()
    assert N.counts("").sum() == 0


def brute_prediction(rows, text):
    """Straight from the definition, with the counts of single n-grams' buckets."""
    docs = [(t, a) for t, a in rows if t and a and any(map(str.isalpha, t))]
    langs = sorted({a for _, a in docs})
    if not langs or not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    def of(t):
        return [N.buckets(t.lower()[i:i + n])[-1] for n in N.ORDERS for i in range(len(t.lower()) - n + 1)]
    score = []
    for a in langs:
        c = np.full(1 << N.BUCKET_BITS, N.SMOOTHING)
        mine = [t for t, x in docs if x == a]
        for t in mine:
            np.add.at(c, of(t), 1)
        score.append(np.log(len(mine) / len(docs)) + np.log(c / c.sum())[of(text)].sum())
    s = np.array(score)
    return langs[int(np.argmax(s))], 1 / np.exp(s - s.max()).sum()


def test_predictions_equal_brute_force_in_one_part_and_many(spark):
    rng = np.random.default_rng(8)
    rows = [("".join(rng.choice(list(letters + " "), 30)), lang) for lang, letters in
            zip("abcdefg", ("abc", "bcd", "cdé", "def", "xyz", "abz", "q")) for _ in range(4)]
    rows += [(None, "a"), ("", "b"), ("12", "c"), ("abc", None)]
    df = spark.createDataFrame([(t, a, "n", 1.0) for t, a in rows], "t string, l string, nb_lang string, nb_top double")
    want = sorted((t or "", *brute_prediction(rows, t)) for t, _ in rows)
    for size in (64, 7, 3, 1):
        got = N.predict(df, "t", N.train(df, "t", "l", size), "p", "q")
        assert got.columns == ["t", "l", "nb_lang", "nb_top", "p", "q"]
        got = sorted((r["t"] or "", r["p"], r["q"]) for r in got.collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-3, atol=1e-6)


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([("abc", "y"), ("abc", "x"), ("abc", "z")], "t string, l string")
    for size in (64, 1):
        assert {(r["p"], round(r["q"], 6)) for r in N.predict(df, "t", N.train(df, "t", "l", size), "p", "q").collect()} == {("x", 0.333333)}


def test_edges(spark, texts, edge_rows, monkeypatch):
    df = texts([*edge_rows, (8, "123 !?"), (9, "é")])
    m = N.train(df, "text", "lang")
    got = N.predict(df, "text", m, "p", "q").collect()
    assert all((r["p"], r["q"]) == ("und", 0.0) if not any(map(str.isalpha, r["text"] or "")) else r["p"] == "en" for r in got)
    nothing = N.train(texts([]), "text", "lang")
    assert {r["p"] for r in N.predict(df, "text", nothing, "p", "q").collect()} == {"und"}
    monkeypatch.setattr(N, "HELD_COUNTS", 1)  # languages handed over early add up all the same
    rows = [("abc", "x"), ("bcd", "y"), ("abd", "x"), ("cde", "y")] * 3
    mixed = N.train(spark.createDataFrame(rows, "t string, l string").coalesce(1), "t", "l")
    monkeypatch.undo()
    again = N.train(spark.createDataFrame(rows, "t string, l string"), "t", "l")
    assert sorted(map(tuple, mixed.counts.collect())) == sorted(map(tuple, again.counts.collect()))
