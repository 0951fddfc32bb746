"""Constant lookup tables embedded in expressions.

A small dimension table (lexicon, capped vocabulary) is brought to the driver only after a
size check and embedded in the plan as an array of small maps indexed by a hash of the key.
Spark's map lookup scans keys linearly, so one big map would cost O(table) per token; the
buckets keep it at a handful of comparisons while staying a pure built-in expression (no
explode, no shuffle, no Python in the tasks). Bucket numbers are computed by Spark itself
(``xxhash64``), so the driver-side layout and the task-side lookup always agree.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..session import MAX_LITERAL_ROWS, bounded_rows, few_rows

_SPARK_JSON_TYPES = {"string", "double", "boolean", "int", "bigint", "float"}


class LookupTable:
    """``key -> struct(value columns)`` as a constant expression."""

    def __init__(self, df: DataFrame, key: str, values: list[str], per_bucket: int = 4,
                 max_rows: int = MAX_LITERAL_ROWS, what: str = "lookup table"):
        types = dict(df.dtypes)
        for c in values:
            if types[c] not in _SPARK_JSON_TYPES:
                raise TypeError(f"lookup value {c} has unsupported type {types[c]}")
        self.value_type = "struct<" + ", ".join(f"{c}:{types[c]}" for c in values) + ">"
        # one action: keys, their Spark hash and values, after the size check
        rows = bounded_rows(
            df.where(F.col(key).isNotNull())
              .select(F.col(key).alias("k"), F.xxhash64(F.col(key)).alias("h"), F.struct(*values).alias("v")),
            max_rows, what)
        self.n_buckets = max(1, (len(rows) + per_bucket - 1) // per_bucket)
        buckets: list[dict] = [dict() for _ in range(self.n_buckets)]
        for r in rows:
            # Python's % on a negative long equals Spark's pmod
            buckets[r["h"] % self.n_buckets][r["k"]] = r["v"].asDict()
        self.size = sum(len(b) for b in buckets)
        self._literal = F.from_json(F.lit(json.dumps(buckets)), f"array<map<string, {self.value_type}>>")

    @classmethod
    def if_small(cls, df: DataFrame, key: str, values: list[str], max_rows: int | None = None) -> LookupTable | None:
        """The table if it has at most ``max_rows`` rows, else None (join it then)."""
        max_rows = MAX_LITERAL_ROWS if max_rows is None else max_rows
        if few_rows(df.where(F.col(key).isNotNull()).select(key), max_rows) is None:
            return None
        return cls(df, key, values, max_rows=max_rows)

    def _bucket(self, k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(self.n_buckets)).cast("int")

    def get(self, k: Column) -> Column:
        """Value struct for key ``k`` or null."""
        return F.get(self._literal, self._bucket(k))[k]

    def contains(self, k: Column) -> Column:
        return self.get(k).isNotNull()
