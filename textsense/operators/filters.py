"""Row filters, heads and samples (ids B1, B2, B4, B6, B7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def drop_null_text(df: DataFrame, col: str) -> DataFrame:
    """B1: remove rows whose text is null."""
    return df.dropna(subset=[col])


def drop_empty_clean(df: DataFrame, cleaned: str, label: str, flag: str | None = None) -> DataFrame:
    """B2: keep rows whose cleaned text is not blank and whose label is set.

    With ``flag`` the rows are kept and a boolean column says which ones pass."""
    cond = (T.strip_ws(F.col(cleaned)) != "") & F.col(label).isNotNull()
    cond = F.coalesce(cond, F.lit(False))
    return df.withColumn(flag, cond) if flag else df.where(cond)


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Ignore whitespace-only (or null) input."""
    return df.where(T.non_blank(col))


def head_by(df: DataFrame, key, n: int) -> DataFrame:
    """First ``n`` rows in key order (a top-k, not a full sort)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def sample_key(key, seed: int = 42):
    """Deterministic per-row sort key for seeded sampling: md5 of 'key:seed'."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """min(n, N) rows without replacement, chosen by a seeded hash of the key.

    A top-k on the hash: each partition keeps its n best, one task merges them."""
    return df.withColumn("__h", sample_key(key, seed)).orderBy("__h", key).limit(n).drop("__h")
