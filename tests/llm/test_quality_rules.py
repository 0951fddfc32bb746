import math
import random
import re

from pyspark.sql import functions as F

from textsense.llm import quality_rules as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    rep = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            rep.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))


def test_counts_equal_brute_force(texts):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice(["the ", "of ", "a\n", "A# ", "été 😀 ", "\n", "\x0b", "x y z ", "1, ", "\xa0"]) for _ in range(rng.randrange(80))))
            for k in range(80)]
    rows += [(100, None), (101, ""), (102, "a b c d e a b c d e"), (102, "a b c d e a b c d e"), (None, "x " * 3000)]
    measured, m = Q.measure(texts(rows), "text", "lang")
    got = measured.select("doc_id", *[F.col(m[c]) for c in Q.COUNTS]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)


def test_js_distance(spark):
    p, q = [8.0, 2.0, 0.0], [0.5, 0.25, 0.25]
    got = spark.range(1).select(Q.js_distance(F.array(*map(F.lit, p)), q)).first()[0]
    a = [x / 10 for x in p]
    mid = [(x + y) / 2 for x, y in zip(a, q)]
    kl = lambda u: sum(x * math.log2(x / z) for x, z in zip(u, mid) if x)
    assert abs(got - math.sqrt((kl(a) + kl(q)) / 2)) < 1e-12
    assert spark.range(1).select(Q.js_distance(F.array(*map(F.lit, q)), q)).first()[0] < 1e-7


def test_keep_rejects_odd_text_and_keeps_clean(spark, texts):
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choice("the of and to in cat dog house tree river runs blue it was stone".split()) + str(rng.randrange(9))
                             if rng.random() < .6 else rng.choice("the of and to in it was".split()) for _ in range(k))
    rows = [(k, say(300).capitalize() + ".") for k in range(60)]
    rows += [(100, say(300).upper().replace(" ", "!! ")), (101, " ".join(f"#{i}$%" for i in range(300))), (102, "too short"), (103, None),
             (104, "same five words here now " * 60)]
    df = texts(rows)
    kept = Q.keep(df, "text", "lang")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60))
    assert Q.keep(texts([]), "text", "lang").count() == 0
    other = df.withColumn("lang", F.lit(None).cast("string"))
    assert {100, 101, 102, 103, 104}.isdisjoint(r["doc_id"] for r in Q.keep(other, "text", "lang").collect())
    assert Q.keep(df, "text", None).count() == 60


def test_query_equals_brute_force(spark):
    SF_SMALL = "/root/testdata/sf0.001"
    from textsense.llm.queries import QUERIES
    want = {r["doc_id"]: brute(r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_quality_rules"](spark, SF_SMALL).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, chars, sym, dup, rep = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["base_failed"] and r["kept"])
