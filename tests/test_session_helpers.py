"""Helpers every operator relies on: the constant lookup table, spread(), materialize()."""

import random

import pytest
from pyspark.sql import functions as F

from textsense.functions.lookup import LookupTable
from textsense.session import SCAN_PARTITIONS, bounded_rows, materialize, spread


def test_lookup_table_equals_dict(spark):
    rnd = random.Random(3)
    keys = {"".join(rnd.choice("abcdéü日 _") for _ in range(rnd.randint(1, 8))) for _ in range(3000)}
    table = {k: (i, i / 7.0) for i, k in enumerate(sorted(keys))}
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in table.items()], "k string, a int, b double")
    lt = LookupTable(df, "k", ["a", "b"], per_bucket=3)
    probes = list(table)[:500] + ["missing", "", "zz9"]
    q = spark.createDataFrame([(p,) for p in probes], "p string")
    got = {r["p"]: r["v"] for r in q.select("p", lt.get(F.col("p")).alias("v")).collect()}
    for p in probes:
        want = table.get(p)
        assert (got[p] is None) if want is None else (got[p]["a"], got[p]["b"]) == want
    assert lt.size == len(table)


def test_bounded_rows_checks_size(spark):
    assert len(bounded_rows(spark.range(5), 5, "x")) == 5
    with pytest.raises(ValueError):
        bounded_rows(spark.range(6), 5, "x")


def test_spread_follows_the_setting(spark):
    few = spark.range(0, 1000, 1, 1)
    assert spread(few) is few
    spark.conf.set(SCAN_PARTITIONS, "3")
    try:
        assert spread(few).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(SCAN_PARTITIONS)


def test_materialize_cuts_lineage(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    m = materialize(df)
    assert sorted(r["x"] for r in m.collect()) == [2 * i for i in range(100)]
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan
