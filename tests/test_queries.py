"""The driver contract: entry() runs; every oracle has a query; every query with an oracle
equals its DuckDB SQL at sf0.001 (tools/oracle_check.py runs the same at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
SF_SMALL = "/root/testdata/sf0.001"

TABLES = "documents labels benchmark pages conversations events".split()


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert rows and {r["sentiment"] for r in rows} >= {"ALL"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr([fix(r[i]) for i in order]) for r in rows), [cols[i] for i in order]


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got, cols = _norm([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(E.oracle_sql()[name])
    want, ocols = _norm(cur.fetchall(), [d[0] for d in cur.description])
    assert cols == ocols and got == want
    # column types agree too (Spark -> DuckDB names)
    rel = con.sql(E.oracle_sql()[name])
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: names.get(t, t) for c, t in df.dtypes} == duck


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0
