"""All registered queries and their DuckDB oracles, merged from the per-area modules."""

from __future__ import annotations

import importlib

_MODULES = ["text_queries", "retrieval_queries", "chat_queries", "model_queries", "stream_queries", "io_queries"]


def _load():
    queries, sql = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"{__package__}.{m}")
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"query {k} registered twice")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql


def all_queries():
    return _load()[0]


def all_sql():
    return _load()[1]
