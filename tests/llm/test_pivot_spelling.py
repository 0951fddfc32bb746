import random
import zlib
from collections import Counter, defaultdict

import pytest

from textsense.llm import pivot_spelling as P
from textsense.llm.queries import QUERIES


def near_brute(words):
    known, out, same = set(words), set(), defaultdict(list)
    for w in known:
        for i in range(len(w)):
            same[i, w[:i], w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in known:
                out.add(tuple(sorted((w, w[:i] + w[i + 1:]))))
    return out | {(a, b) for v in same.values() for a in v for b in v if a < b}


def counts_brute(docs, every):
    import re
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                n[w] += 1
    return n


def variants_brute(docs, every, least=5, ratio=5):
    n = {w: k for w, k in counts_brute(docs, every).items() if k >= least}
    near = defaultdict(list)
    for a, b in near_brute(n):
        near[a].append(b)
        near[b].append(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("letters,lo,hi,many", [("ab", 4, 9, 600), ("abcé÷", 6, 9, 3000), ("abcdefgh", 4, 7, 3000)])
def test_near_pairs_equal_brute_force(spark, letters, lo, hi, many):
    rng = random.Random(hi * many)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(lo, hi))) for _ in range(many)} | {"aaaa", "aaaaa", "a" * 300, "a" * 301})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint").repartition(3)
    got = [(r["a"], r["b"], r["a_n"], r["b_n"]) for r in P.near_pairs(df).collect()]
    assert {x[:2] for x in got} == near_brute(words) and len(got) == len({x[:2] for x in got})
    assert all(words[n] == a and words[m] == b for a, b, n, m in got)


def test_pivots_are_disjoint_and_of_least_weight():
    rng = random.Random(2)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(1, 7)))
        weights = [rng.randint(1, 9) for _ in places]
        every = [weights[i] + weights[j] for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2]
        got = P.pivots(places, weights)
        assert (got is None) == (not every)
        if got:
            assert places[got[1]] - places[got[0]] >= 2 and weights[got[0]] + weights[got[1]] == min(every)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdéÿ") for _ in range(rng.randint(6, 9))) for _ in range(30)]

    def spoil(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1:], w.upper()])
    docs = [(i, " ".join(spoil(w) if rng.random() < 0.4 else w for w in rng.choices(base[:12], k=60) + rng.choices(base, k=20)) + ", Ωmega 日本abcdef×a")
            for i in range(60)]
    return docs + [(None, "abcabcd " * 30), (7, None), (8, ""), (9, " \n"), (9, "x1y2 " * 20_000), (10, "chain" * 40_000),
                   (11, "zzkette " * 5 + "zzketten " * 25 + "zzkettens " * 125)] + [docs[3]] * 5


def test_variants_equal_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in corpus], "doc_id bigint, text string, word string, n int").repartition(4)
    for every in (3, 199, None):
        assert rows_of(P.variants(df, "doc_id", "text", every)) == variants_brute(corpus, every)
    assert any(f and f != r for _, f, r, *_ in variants_brute(corpus, None))  # a chain of forms


def test_words_handed_over_early_count_the_same(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string").coalesce(1)
    got = {r["word"]: r["n"] for r in P.word_counts(df, "doc_id", "text", 3).collect()}
    assert got == counts_brute(corpus, 3)


def test_long_chains_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in P.roots(forms).collect()} == {f"w{i}": "w21" for i in range(21)} | {"x": "w21"}


def test_empty_table_and_short_words(spark):
    assert P.variants(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        P.variants(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", min_length=3)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_pivot_spelling"](spark, sf)) == variants_brute(docs, 199)
