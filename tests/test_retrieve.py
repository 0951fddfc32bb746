"""TF-IDF weights against a brute-force computation, top-k padding, prompts."""

import math
from collections import Counter

import pytest

from textsense.operators import prompts as P
from textsense.operators import retrieve as R
from textsense.operators import vocab as V

DOCS = [(1, "The cat sat on the mat."), (2, "Dogs and cats, living together!"),
        (3, "A mat is not a cat; the mat is red."), (4, ""), (5, "Zebra zebra zebra")]
QUERIES = [(10, "cat on a mat"), (11, "nothing known here"), (12, "zebra dogs")]


def brute_weights(texts, max_terms):
    import re
    toks = {k: re.findall(r"[\w]{2,}", t.lower()) for k, t in texts}
    grams = {k: w + [f"{a} {b}" for a, b in zip(w, w[1:])] for k, w in toks.items()}
    tf = {k: Counter(g) for k, g in grams.items()}
    total, df = Counter(), Counter()
    for c in tf.values():
        total.update(c)
        df.update(c.keys())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:max_terms]
    n = len(texts)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for k, c in tf.items():
        w = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[k] = {t: x / norm for t, x in w.items()} if norm else {}
    return out, idf


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize("max_terms", [5000, 6])
def test_weights_match_brute_force(spark, docs, max_terms):
    expect, idf = brute_weights(DOCS, max_terms)
    voc = V.fit_vocabulary(docs, "doc_id", "text", max_terms)
    assert {r["term"]: r["idf"] for r in voc.df.collect()} == pytest.approx(idf)
    got = {}
    for r in V.postings(V.tfidf(docs, "doc_id", "text", voc), "doc_id").collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for k in expect:
        assert got.get(k, {}) == pytest.approx(expect[k])


def test_term_counts_in_row(spark, docs):
    rows = V.term_counts(docs, "doc_id", "text").where("doc_id = 5").collect()
    assert {r["term"]: r["tf"] for r in rows} == {"zebra": 3, "zebra zebra": 2}


def test_topk_pads_with_highest_ids_and_zero(spark, docs):
    idx = R.build_index(docs, "doc_id", "text")
    q = spark.createDataFrame(QUERIES, "qid long, q string")
    hits = R.retrieve(q, "qid", "q", idx, 3).collect()
    by_q = {}
    for r in hits:
        by_q.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["sim"]))
    assert all(len(v) == 3 for v in by_q.values())
    assert [d for _, d, _ in sorted(by_q[11])] == [5, 4, 3] and all(s == 0 for *_, s in by_q[11])
    ranked = [d for _, d, s in sorted(by_q[10])]
    assert ranked[0] in (1, 3) and set(ranked[:2]) == {1, 3}


def test_topk_is_prefix_of_full_ranking(spark, docs):
    idx = R.build_index(docs, "doc_id", "text")
    q = spark.createDataFrame(QUERIES, "qid long, q string")
    small = {(r["query_id"], r["doc_id"]) for r in R.retrieve(q, "qid", "q", idx, 2).collect()}
    full = {(r["query_id"], r["doc_id"], r["rank"]) for r in R.retrieve(q, "qid", "q", idx, 5).collect()}
    assert small == {(a, b) for a, b, rk in full if rk <= 2}


def test_saved_index_gives_same_hits(spark, docs, tmp_path):
    q = spark.createDataFrame(QUERIES, "qid long, q string")
    idx = R.build_index(docs, "doc_id", "text")
    idx.save(str(tmp_path / "index"))
    back = R.Index.load(spark, str(tmp_path / "index"))
    assert sorted(R.retrieve(q, "qid", "q", idx, 3).collect()) == sorted(R.retrieve(q, "qid", "q", back, 3).collect())


@pytest.mark.parametrize("n_docs,n_q,block", [(40, 9, 4), (9, 40, 4), (30, 30, 1024)])
def test_topk_equals_brute_force_in_blocks(spark, n_docs, n_q, block):
    import random
    rnd = random.Random(n_docs)
    words = "cat dog mat zebra red blue tree house river stone".split()
    say = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(8)))
    texts, qs = [(i, say()) for i in range(n_docs)], [(1000 + i, say()) for i in range(n_q)]
    idx = R.build_index(spark.createDataFrame(texts, "k long, t string").repartition(3), "k", "t", 12)
    got = R.retrieve(spark.createDataFrame(qs, "q long, t string"), "q", "t", idx, 3, block=block).collect()
    weights, idf = brute_weights(texts, 12)
    for q, t in qs:
        import re
        toks = re.findall(r"[\w]{2,}", t.lower())
        tf = Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])
        w = {x: tf[x] * idf[x] for x in tf if x in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        sims = {d: sum(w[x] / norm * y for x, y in weights[d].items() if x in w) for d, _ in texts}
        best = sorted(sims, key=lambda d: (-round(sims[d], 9), -d))[:3]
        mine = sorted((r["rank"], r["doc_id"], r["sim"]) for r in got if r["query_id"] == q)
        assert [d for _, d, _ in mine] == best
        assert [s for *_, s in mine] == pytest.approx([sims[d] for d in best])


def test_many_questions_and_blocks_equal_brute_force(spark, monkeypatch):
    """10,000 questions, documents in many blocks (cut by rows and by postings), a word that every
    text has, repeated documents; nothing but the padding ids may be fetched to the driver."""
    import random

    import numpy as np
    from pyspark.sql import DataFrame
    rnd = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)]
    say = lambda n: " ".join(["all", *rnd.choices(words, k=rnd.randrange(n))])
    texts = [(i, say(9)) for i in range(90)] + [(100 + i, "all w01 w02") for i in range(7)] + [(200, ""), (201, None)]
    qs = [(i, say(5)) for i in range(9_998)] + [(9_998, ""), (9_999, None)]
    monkeypatch.setattr(R, "BLOCK_POSTINGS", 60)
    idx = R.build_index(spark.createDataFrame(texts, "k long, t string").repartition(3), "k", "t", 30, (1, 1), block=8)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    got = R.retrieve(spark.createDataFrame(qs, "q long, t string").repartition(4), "q", "t", idx, 4, block=500).toPandas()
    weights, idf = brute_weights([(k, (t or "").lower()) for k, t in texts], 10**6)
    total = Counter(w for _, t in texts for w in (t or "").split())
    kept = sorted(total, key=lambda t: (-total[t], t))[:30]
    at = {t: i for i, t in enumerate(kept)}

    def vectors(rows):
        m = np.zeros((len(rows), len(kept)))
        for i, (_, t) in enumerate(rows):
            for w in (t or "").split():
                if w in at:
                    m[i, at[w]] += idf[w]
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    down = sorted(texts, reverse=True, key=lambda r: r[0])
    sims = vectors(qs) @ vectors(down).T
    top = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :4]
    got = got.sort_values(["query_id", "rank"])
    assert len(got) == 4 * len(qs)
    assert (got["doc_id"].to_numpy().reshape(-1, 4) == np.array([k for k, _ in down])[top]).all()
    assert np.allclose(got["sim"].to_numpy().reshape(-1, 4), np.take_along_axis(sims, top, axis=1))


def test_blocks_are_cut_by_rows_and_postings(spark, docs):
    import numpy as np
    assert R._cuts(np.array([1] * 5), 2) == [(0, 2), (2, 4), (4, 5)]
    assert R._cuts(np.array([R.BLOCK_POSTINGS + 1, 1, R.BLOCK_POSTINGS]), 9) == [(0, 1), (1, 2), (2, 3)]
    assert R._cuts(np.array([], dtype=int), 9) == []
    idx = R.build_index(docs.repartition(1), "doc_id", "text", block=2)
    heads = idx.blocks.where(idx.blocks.term == R.HEAD).collect()
    assert all(len(r["ids"]) <= 2 and r["ids"] == sorted(r["ids"], reverse=True) for r in heads)
    assert sorted(i for r in heads for i in r["ids"]) == [1, 2, 3, 4, 5]


def test_text_keys_and_empty_questions(spark):
    idx = R.build_index(spark.createDataFrame([("a", "cat mat"), ("b", "dog")], "k string, t string"), "k", "t")
    q = spark.createDataFrame([("x", "dog"), ("y", "")], "q string, t string")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in R.retrieve(q, "q", "t", idx, 3).collect())
    assert got == [("x", 1, "b"), ("x", 2, "a"), ("y", 1, "b"), ("y", 2, "a")]
    assert R.retrieve(q.limit(0), "q", "t", idx, 3).count() == 0


def test_empty_corpus_finds_nothing(spark):
    idx = R.build_index(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert R.retrieve(spark.createDataFrame(QUERIES, "qid long, q string"), "qid", "q", idx, 3).count() == 0


def test_uncapped_large_vocabulary_joins(spark, docs, monkeypatch):
    small = V.fit_vocabulary(docs, "doc_id", "text", None)
    monkeypatch.setattr(V, "MAX_LITERAL_ROWS", 3)
    large = V.fit_vocabulary(docs, "doc_id", "text", None)
    assert small.table is not None and large.table is None and large.size == small.size
    rows = [sorted((r["doc_id"], r["term"], r["tf"], round(r["weight"], 9)) for r in V.postings(
        V.tfidf(docs, "doc_id", "text", v), "doc_id").collect()) for v in (small, large)]
    assert rows[0] == rows[1] and rows[0]


def test_context_and_prompts(spark, docs):
    hits = spark.createDataFrame([(10, 1, 3), (10, 2, 1)], "query_id long, rank int, doc_id long")
    ctx = P.context_block(hits, docs, "doc_id", "text").first()
    assert ctx["sources"] == ["3", "1"]
    assert ctx["context"] == "[3]\nA mat is not a cat; the mat is red.\n\n[1]\nThe cat sat on the mat."
    web = spark.createDataFrame([(10, 1, None, " "), (10, 2, "T", " body "), (10, 3, "", "x"), (10, 4, "late", "y")],
                                "g long, o int, title string, content string")
    w = P.normalise_results(web, "g", "o", k=3).withColumnRenamed("g", "query_id")
    wr = w.first()
    assert wr["sources"] == ["web: T", "web: Untitled Source"]
    assert wr["context"] == "[T]\nbody\n\n[Untitled Source]\nx"
    q = spark.createDataFrame([(10, "cat?"), (11, "dog?")], "id long, q string")
    doc_ctx = P.context_block(hits, docs, "doc_id", "text")
    on = {r["query_id"]: r for r in P.build_prompts(q, "id", "q", doc_ctx, w, True, True).collect()}
    assert on[10]["prompt"].startswith(P.RAG_INSTRUCTION + "\n\nContext:\n[3]\n")
    assert on[10]["prompt"].endswith("[Untitled Source]\nx\n\nQuestion: cat?")
    assert on[10]["sources"] == ["3", "1", "web: T", "web: Untitled Source"]
    assert on[11]["prompt"] == "dog?" and on[11]["sources"] == []
    off = {r["query_id"]: r for r in P.build_prompts(q, "id", "q", doc_ctx, w, False, True).collect()}
    assert off[10]["prompt"] == "cat?" and off[10]["sources"] == ["web: T", "web: Untitled Source"]
    simple = P.simple_prompt(q, "id", "q").where("query_id = 10").first()["prompt"]
    assert simple.endswith("\n\nUser: cat?")
