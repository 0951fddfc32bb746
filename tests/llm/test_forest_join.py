import collections
import random
import re

import numpy as np
import pytest

from textsense.llm import forest_join as J
from textsense.llm.components import components


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, t=0.8):
    s = [shingles(x) for _, x in docs]
    n, root = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-12:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(docs[i][0], least.get(find(i)), n[i]) for i in range(len(docs))], key=repr)


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    docs = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "One TWO"), (504, "one two"), (None, "one two"), (3, docs[3][1]), (3, docs[3][1])]
    return docs


@pytest.mark.parametrize("block", [512, 3])
def test_classes_equal_brute_force(texts, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_NODES", block)
    docs = corpus()
    got = J.classes(texts(docs), "doc_id", "text").collect()
    assert sorted([(r["id"], r["class_id"], r["n_links"]) for r in got], key=repr) == brute(docs)


def test_keep_one(texts):
    docs = corpus(2)
    df = texts(docs)
    kept = J.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = brute(docs)
    empty = [d for d in docs if not shingles(d[1])]
    classes = {c for d, c, _ in want if (d, c) not in [(e[0], e[0]) for e in empty]}
    assert sorted(map(repr, [d for d, t in rows if shingles(t)])) == sorted(map(repr, classes))
    assert sorted(map(repr, [d for d in rows if not shingles(d[1])])) == sorted(map(repr, empty))


def test_empty(texts):
    assert J.classes(texts([]), "doc_id", "text").count() == 0
    assert J.keep_one(texts([]), "doc_id", "text").count() == 0


def plan(**changed):
    args = dict(trees=J.TREES, depth=J.DEPTH, threshold=J.THRESHOLD, target=J.TARGET_RECALL) | changed
    return J.shortenings(**args)


def test_least_similarity_by_all_sizes():
    for t in (0.5, 0.8, 0.9):
        for n in range(1, 40):
            seen = [both / (n + m - both) for m in range(1, 90) for both in range(1, min(n, m) + 1) if not n == m == both]
            want = min([x for x in seen if x >= t - 1e-9], default=1.0)
            assert abs(J.least_similarity(n, t) - want) < 1e-12, (n, t)


def test_prefixes_are_shortened_only_until_the_target():
    steps, recall = plan()
    assert steps[3] == 0 and recall[3] == 1  # three shingles: no other set is that similar
    assert 0 < steps[J.FEW + 1] < J.TREES and steps[6] == 0  # by a text's own size: 6 shingles share 5 of 6 at least
    assert len(set(plan(target=0.99999)[0])) > 2
    for n, k in enumerate(steps):
        assert recall[n] >= J.TARGET_RECALL
        assert k == 0 or 1 - J.miss(J.least_similarity(n, 0.8), k - 1, J.TREES, J.DEPTH) < J.TARGET_RECALL
    assert plan(trees=200)[0][-1] == 0 and plan(target=0.999999)[0][-1] > J.TREES
    short = plan(trees=2)[0][-1]  # a target out of reach ends at one value a tree
    assert short == 2 * (J.DEPTH - 1) and [J.depth_in(t, short, 2, J.DEPTH) for t in (0, 1)] == [1, 1]


def test_recall_at_threshold():
    rng = np.random.default_rng(0)
    shift = J.VALUE_BITS * (J.DEPTH - J.depth_in(np.arange(J.TREES), plan()[0][-1], J.TREES, J.DEPTH))
    found = 0
    for _ in range(300):
        a = rng.integers(1, 1 << 63, 100, dtype=np.uint64)
        b = a.copy()
        b[:11] = rng.integers(1, 1 << 63, 11, dtype=np.uint64)  # 89 of 111 shared: 0.80
        keys = J.signature_keys([np.unique(a), np.unique(b)], J.TREES, J.DEPTH)
        found += bool((keys[0] >> shift == keys[1] >> shift).any())
    assert found >= 298


def test_chain_of_chance_candidates(texts, monkeypatch):
    """Texts that overlap with the next one by half are candidates now and then with two trees of few
    values, so the candidates hang together; no two of them are similar. Mixed with real copies."""
    monkeypatch.setattr(J, "BLOCK_NODES", 8)
    words = [f"w{i}" for i in range(1500)]
    docs = [(i, " ".join(words[12 * i:12 * i + 40])) for i in range(120)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(0, 120, 7)]
    df, steps = texts(docs), plan(depth=1)[0]
    marked = []
    real = J._places
    monkeypatch.setattr(J, "_places", lambda members, *a: marked.append((members, real(members, *a))) or marked[-1][1])
    got = J.classes(df, "doc_id", "text", depth=1).collect()
    assert sorted([(r["id"], r["class_id"], r["n_links"]) for r in got], key=repr) == brute(docs)
    members, places = marked[0]
    assert set(steps) == {0} and members.groupBy("label").count().agg({"count": "max"}).first()[0] > 60  # one long chain ...
    rows = places.selectExpr("inline(places)").collect()
    assert any(r["branch"] >= 0 for r in rows)  # ... which is not compared whole
    tasks = {(r["branch"], r["label"]): r["blocks"] for r in rows}
    assert sum(b * (b + 1) // 2 * 8 * 8 for b in tasks.values()) < 137 * 137 * J.TREES


@pytest.mark.parametrize("apart", [True, False])
def test_trie_nodes_and_whole_clusters_agree(texts, monkeypatch, apart):
    monkeypatch.setattr(J, "BLOCK_NODES", 2)
    monkeypatch.setattr(J, "_less_apart", lambda: J.F.lit(apart))
    docs = corpus(5, 30)
    got = J.classes(texts(docs), "doc_id", "text").collect()
    assert sorted([(r["id"], r["class_id"], r["n_links"]) for r in got], key=repr) == brute(docs)
    assert all((r["recall"] is None) == (not r["n_shingles"]) for r in got)


def test_very_long_text_and_edges(texts, edge_rows):
    long = edge_rows[3][1]
    docs = [*edge_rows, (8, long + " end"), (9, long.replace("w0x0 ", "")), (10, long.upper())]
    got = J.classes(texts(docs), "doc_id", "text").collect()
    assert sorted([(r["id"], r["class_id"], r["n_links"]) for r in got], key=repr) == brute(docs)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[v] == min(seen)
    assert set(got) == set(near)


def test_links_with_empty_blocks(texts, monkeypatch):
    # few long texts: more blocks than texts, so some blocks of a cluster have no member
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 60)
    rng = random.Random(7)
    docs = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(4000)}" for _ in range(150)]
        docs += [(3 * g + k, " ".join([*base, f"end{k}"])) for k in range(3 if g % 2 else 2)]
    got = J.classes(texts(docs), "doc_id", "text").collect()
    assert sorted([(r["id"], r["class_id"], r["n_links"]) for r in got], key=repr) == brute(docs)
