import collections
import zlib

import pytest

from textsense.llm import label_shards as S


def check(rows, docs, k):
    assert len(rows) == len(docs)
    sizes = collections.Counter(r["shard"] for r in rows)
    counts = [sizes[s] for s in range(k)]
    assert max(counts) - min(counts) <= 1
    for s in range(k):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


@pytest.mark.parametrize("copies", [0, 3, 150])
def test_balanced_and_together(texts, copies):
    docs = [(k, f"text {k // max(copies, 1)}") for k in range(300)] + [(900, None), (901, None), (902, ""), (902, "")]
    rows = S.shard(texts(docs), "doc_id", "text", k=5).collect()
    check(rows, docs, 5)
    if copies == 3:  # a few groups may lie on a border
        homes = collections.defaultdict(set)
        for r in rows:
            if r["doc_id"] < 300:
                homes[r["text_crc32"]].add(r["shard"])
        assert sum(len(h) > 1 for h in homes.values()) <= 8


def test_hot_group_fills_few_shards(texts):
    docs = [(k, "hot") for k in range(400)] + [(1000 + k, f"t{k}") for k in range(800)]
    rows = S.shard(texts(docs), "doc_id", "text", k=12).collect()
    check(rows, docs, 12)
    assert len({r["shard"] for r in rows if r["doc_id"] < 1000}) <= 8  # 4 would hold it; it started in 12


def test_edges(texts):
    assert S.shard(texts([]), "doc_id", "text").count() == 0
    check(S.shard(texts([(1, "a"), (1, "a")]), "doc_id", "text", k=24).collect(), [(1, "a"), (1, "a")], 24)
    rows = S.shard(texts([(None, "a"), (2, None)]), "doc_id", "text", k=2).collect()
    assert {r["shard"] for r in rows} == {0, 1}


def test_result_does_not_depend_on_the_input_layout(texts):
    import random
    docs = [(k, f"text {k // 4}") for k in range(200)] + [(300 + k, "hot") for k in range(150)] + \
           [(500 + k, f"alone {k}") for k in range(100)] + [(None, "hot"), (7, "text 1"), (7, "text 1"), (900, None), (901, None), (902, "")]
    want = None
    for seed, parts in [(0, 1), (1, 5), (2, 13)]:
        random.Random(seed).shuffle(docs)
        rows = sorted(map(tuple, S.shard(texts(docs).repartition(parts), "doc_id", "text", k=7).collect()), key=repr)
        want = want or rows
        assert rows == want


def test_cut_links_are_fewer_than_at_the_start_and_equal_brute_force(texts, spark):
    import itertools

    from pyspark.sql import functions as F
    docs = [(k, f"text {k % 60}") for k in range(240)] + [(1000 + k, f"t{k}") for k in range(60)] + [(2000, None), (2001, None)]
    got = S.shard(texts(docs), "doc_id", "text", k=6)
    text = dict(docs)

    def brute(rows):
        pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if text[a[0]] is not None and text[a[0]] == text[b[0]]]
        return len(pairs), sum(a[1] != b[1] for a, b in pairs)

    counted = []
    for shards in (got.select("doc_id", "shard"), got.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(6)).alias("shard"))):
        rows = [tuple(r) for r in shards.collect()]
        with_text = spark.createDataFrame([(i, s, text[i]) for i, s in rows], "doc_id long, shard int, text string")
        counted.append(tuple(map(int, S.cut_links(with_text, "text", "shard").first())))
        assert counted[-1] == brute(rows)
    assert counted[0][0] == counted[1][0] == 360
    assert counted[0][1] * 5 < counted[1][1]  # at most a fifth of the links that a random dealing cuts
    assert tuple(map(int, S.cut_links(with_text.limit(0), "text", "shard").first())) == (0, 0)


def test_very_long_texts_and_clashing_columns(texts, edge_rows):
    rows = S.shard(texts(edge_rows), "doc_id", "text", k=3).collect()
    assert len(rows) == len(edge_rows)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 8 for _, t in edge_rows)
