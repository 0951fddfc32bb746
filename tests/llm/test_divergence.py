import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from textsense.llm import divergence as D
from textsense.llm.queries import QUERIES, SQL

TINY = D.Limits(shard_keys=40, round_bytes=900, held_cells=300, block_cells=150)


def brute(rows, min_docs=3, top=200):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))
            for t, a, b in rows]
    df, n, groups = Counter(), defaultdict(Counter), {(a, b) for a, b, _ in docs}
    for a, _, ws in docs:
        df.update((a, w) for w in set(ws))
    kept = defaultdict(set)
    for (a, w), k in df.items():
        if k >= min_docs:
            kept[a].add(w)
    for a, b, ws in docs:
        n[a, b].update(w for w in ws if w in kept[a])
    lang = defaultdict(Counter)
    for (a, _), c in n.items():
        lang[a].update(c)

    def p(c, a):
        mass = sum(c.values()) + len(kept[a])
        return {w: 1 + 10**9 * (c[w] + 1) // mass for w in kept[a]}
    share = {g: p(n[g], g[0]) for g in groups}
    out = []
    for a, b in groups:
        pair = [(o, sum((share[a, b][w] - share[a, o][w]) ** 2 // share[a, o][w] for w in kept[a])) for x, o in groups if x == a and o != b]
        q = p(lang[a], a)
        term = [(w, (share[a, b][w] - q[w]) ** 2 // q[w]) for w in kept[a] if n[a, b][w] and share[a, b][w] > q[w]]
        for part, some, most in (("pair", pair, None), ("term", term, top)):
            some.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(a, b, part, i, v, k + 1) for k, (i, v) in enumerate(some[:most])]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 4))) for _ in range(90)] + ["Ünï", "日本", "x"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), ["en", "de", ""][int(rng.integers(3))], f"s{rng.integers(6)}") for _ in range(120)]
    rows += [(None, "en", "s0"), ("", "fr", "only"), ("A1B a-b", None, None), ("a b", None, "s1"), ("q" * 50_000 + " a " * 50_000, "en", "s9")]
    rows += [rows[3]] * 4 + [("none kept here", "zz", "u"), (None, "zz", "v")]
    return rows


def test_equals_brute_force(spark, corpus):
    df = spark.createDataFrame([(t, a, b, 1, "x") for t, a, b in corpus], "text string, lang string, source string, key int, word string")
    want = brute(corpus)
    assert rows_of(D.audit(df.repartition(3), "text", "lang", "source")) == want
    assert any(r[0] == "zz" and r[2] == "pair" and r[4] == 0 for r in want)


def test_rounds_shards_and_blocks_change_nothing(spark, corpus):
    df = spark.createDataFrame(corpus, "text string, lang string, source string")
    idx = D.index(D.kept_terms(D._source(df, "text", "lang", "source")), TINY)
    assert idx.shards > 3 and len(idx.rounds) > 1
    assert rows_of(D.audit(df.repartition(4), "text", "lang", "source", limits=TINY)) == brute(corpus)


def test_top_and_documents_needed(spark, corpus):
    df = spark.createDataFrame(corpus, "text string, lang string, source string")
    assert rows_of(D.audit(df, "text", "lang", "source", min_docs=5, top=3)) == brute(corpus, 5, 3)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string"), "text", "lang", "source").collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert rows_of(QUERIES["op11_source_divergence"](spark, sf)) == sorted(c.execute(SQL["op11_source_divergence"]).fetchall())


def shards_of(keys, hashes):
    sizes, bits, slot = D.build(hashes)
    order = np.argsort(slot)
    return D.Shards(pa.table({"shard": [0], "base": [0], "n": [len(keys)], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()),
                              "langs": [["x"] * len(keys)], "words": [[keys[i] for i in order]]}), 1)


def test_perfect_hash_is_minimal_and_verified():
    keys = [f"k{i}" for i in range(5000)]
    arr, x = pa.array(keys), pa.array(["x"] * 5000)
    s = shards_of(keys, D.key_hashes(x, arr))
    got = s.slots(x, arr)
    assert sorted(got) == list(range(5000)) and not s.rest
    assert (s.slots(pa.array(["y"] * 5000), arr) == -1).all()
    assert (s.slots(x, pa.array([f"no{i}" for i in range(5000)])) == -1).all()


def test_equal_hashes_still_have_slots_of_their_own(monkeypatch):
    monkeypatch.setattr(D, "key_hashes", lambda langs, words: np.array([len(w.as_py()) for w in words], dtype=np.uint64))
    keys = ["a", "b", "cc", "ddd", "eee", "ffff"]
    x = pa.array(["x"] * 6)
    s = shards_of(keys, D.key_hashes(x, pa.array(keys)))
    assert len(s.rest) == 4 and sorted(s.slots(x, pa.array(keys))) == list(range(6))
    assert (s.slots(x, pa.array(["z", "zz", "zzz", "zzzz", "", "zzzzz"])) == -1).all()


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    mass = rng.integers(1, 9 * 10**15, 300)
    count = (rng.random(300) * mass).astype(np.int64)
    assert D.shares(count, mass).tolist() == [1 + 10**9 * (int(c) + 1) // int(m) for c, m in zip(count, mass)]
