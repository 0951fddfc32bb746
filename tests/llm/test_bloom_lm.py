import collections
import math
import re
import zlib

import numpy as np
import pytest

from textsense.llm import bloom_lm as L
from textsense.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}


def split(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"]


def brute(docs, learn):
    c = collections.Counter(w for i, t in docs if learn(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return {k: (len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in split(t)))
            for k, (i, t) in enumerate(docs)}


def test_query_equals_brute_force_and_beats_unigrams(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    want = {docs[k][0]: v for k, v in brute(docs, learn).items()}
    rows = QUERIES["op10_bloom_lm"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, not learn(r["doc_id"]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("head", [4, 1 << 20])
def test_small_head_gives_the_same_scores(spark, texts, edge_rows, head):
    docs = [*edge_rows, (20, "a b a b c A"), (21, "b c d e f g h"), (22, "a a a a")]
    df = texts(docs)
    model, words = L.train(df.where("doc_id < 22"), "text", head=head)
    got = L.score(df, "doc_id", "text", model, words).collect()
    want = sorted(brute(docs, lambda i: i is not None and i < 22).values(), key=repr)
    assert sorted([(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got], key=repr) == sorted([w[:3] for w in want], key=repr)
    assert np.allclose(sorted(r["base_score"] for r in got), sorted(w[3] for w in want))
    assert all(r["score"] < 0 for r in got)


def test_nothing_to_learn_from(texts):
    model, words = L.train(texts([]), "text")
    r = L.score(texts([(1, "a b"), (2, None)]), "doc_id", "text", model, words).orderBy("id").collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"]) for x in r] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    model, words = L.train(texts([(1, "a b")]), "text")
    assert L.score(texts([]), "doc_id", "text", model, words).count() == 0


def stored_levels(model):
    """Function from hashes to the levels that the stored filter gives them."""
    bits = {r["block"]: np.frombuffer(r["bits"], np.uint8) for r in model.filter.collect()}

    def level(h):
        h = np.asarray(h, np.uint64)
        block = (h >> np.uint64(65 - model.blocks.bit_length())).astype(int)
        return np.array([L._block_levels(bits.get(b, np.empty(0, np.uint8)), L._keys(h[i:i + 1], model.blocks))[0] for i, b in enumerate(block)])
    return level


def tokens(t):
    return L.tokens(np.frombuffer((t or "").encode(), np.uint8))


def log_score(model, level, t):
    w = tokens(t)
    count = lambda h: L.middle(level(h))
    p1 = (count(w) + 1) / (model.n_filter + model.v + 1)
    ctx, pair = count(w[:-1]), count(L.pair_hash(w[:-1], w[1:]))
    return np.log10(p1[0]) + np.log10((np.minimum(ctx, pair) + L.MU * p1[1:]) / (ctx + L.MU)).sum()


@pytest.mark.parametrize("size", [1, 30, 4 << 20])
def test_scores_of_slices_equal_the_formula(texts, edge_rows, monkeypatch, size):
    monkeypatch.setattr(L, "SLICE", size)
    docs = [*(r for r in edge_rows if len(r[1] or "") < 100), (20, "a b a b c A"), (21, "b c d e f g h"), (22, "a a a a x y")]
    df = texts(docs)
    model, words = L.train(df.where("doc_id < 22"), "text")
    level = stored_levels(model)
    for i, n in {"a": 3, "b": 3, "c": 2}.items():
        assert level(tokens(i)[:1])[0] >= 1 + math.floor(math.log2(n))
    got = sorted(r["score"] for r in L.score(df, "doc_id", "text", model, words).collect())
    assert np.allclose(got, sorted(log_score(model, level, t) for _, t in docs))


def test_filter_has_no_greatest_size(spark):
    # more entries than 2^27 bits have room for; the rare ones were left out
    many = spark.range(520_000).selectExpr("xxhash64(id) as h", "shiftleft(1L, 47) as c")
    rare = spark.range(1_000).selectExpr("xxhash64(-1 - id) as h", "1L as c")
    blocks = L.store_filter(many.unionByName(rare), spark.createDataFrame([], "t string"), np.concatenate, 256)
    assert blocks.selectExpr("sum(length(bits))").first()[0] * 8 > 1 << 27
    bits = {r["block"]: r["bits"] for r in blocks.collect()}
    for r in rare.collect():
        h = np.array([r["h"]]).view(np.uint64)
        assert L._block_levels(np.frombuffer(bits[int(h[0]) >> 56], np.uint8), L._keys(h, 256))[0] >= 1


def test_block_count_grows_with_the_input():
    assert [L.block_count(n) for n in (0, 1, 256 << 20, (256 << 20) + 1, 10 ** 13)] == [256, 256, 256, 512, 1 << 24]


def test_pairs_of_rare_words_are_counted(texts):
    # 17,000 more frequent words: "odd" and "couple" were in no pair
    docs = [(i, " ".join(f"w{j}" for j in range(1000 * i, 1000 * i + 1000)) + "\n" + " ".join(f"w{j}" for j in range(1000 * i, 1000 * i + 1000)))
            for i in range(17)] + [(17, "odd couple")]
    model, words = L.train(texts(docs), "text")
    got = L.score(texts([(1, "odd couple"), (2, "couple odd")]), "doc_id", "text", model, words).orderBy("id").collect()
    p1 = 2 / (model.n_filter + model.v + 1)
    end = (L.middle(np.array(5)) + 1) / (model.n_filter + model.v + 1)  # 18 ends
    seen = [p1, (1 + L.MU * p1) / (1 + L.MU), (1 + L.MU * end) / (1 + L.MU)]
    assert math.isclose(got[0]["score"], sum(map(math.log10, seen)), rel_tol=1e-9)
    assert got[0]["score"] > got[1]["score"]
