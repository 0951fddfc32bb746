"""Stemming (ids C8, C10, U2).

The stemmer is the one piece of per-token Python. Two forms:

* ``stem_tokens_col`` -- the default: an Arrow UDF that flattens a batch's token arrays,
  dictionary-encodes them, stems the dictionary (through a per-worker memo of bounded size)
  and takes the stems by index: Python sees each distinct token of a batch once, and rows
  never leave their partition;
* ``stem_vocabulary`` -- the distinct-token table (token, stem, n): distinct tokens are a
  partially aggregated shuffle, then stemmed in ``mapInPandas`` batches. This is the map a
  user persists or inspects; joining it back to every token would shuffle all tokens twice
  (to the join, then back to the document), which is why the array form is the default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import porter
from ..functions import text as T

_MEMO: dict = {}
_MEMO_BYTES = 64 << 20   # of tokens, stems and dictionary entries, about
_memo_bytes = 0


def _stem_memo(tok: str | None) -> str | None:
    global _memo_bytes
    s = _MEMO.get(tok)
    if s is None and tok is not None:
        if _memo_bytes > _MEMO_BYTES:
            _MEMO.clear()
            _memo_bytes = 0
        s = _MEMO[tok] = porter.stem(tok)
        _memo_bytes += 200 + len(tok) + len(s)
    return s


@F.arrow_udf(ArrayType(StringType()))
def _stem_arrays(tokens: pa.Array) -> pa.Array:
    flat = tokens.flatten().dictionary_encode()
    stems = pa.array([_stem_memo(t) for t in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), stems, mask=tokens.is_null())


def stem_tokens_col(tokens) -> Column:
    """C8 / U2 on an array<string> column: stems in the same order, duplicates kept."""
    return _stem_arrays(F.col(tokens) if isinstance(tokens, str) else tokens)


def clean_and_stem_col(col) -> Column:
    """C1-C7, Porter stems, space-joined; null -> ''."""
    return T.join_tokens(stem_tokens_col(T.clean_tokens(col)))


def clean_and_stem(df: DataFrame, key, col: str, out: str = "cleaned") -> DataFrame:
    """C10 as a DataFrame operator: ``df`` plus ``out`` (narrow)."""
    return df.withColumn(out, clean_and_stem_col(col))


def _stem_batches(batches):
    for pdf in batches:
        pdf["stem"] = pdf["token"].map(porter.stem)
        yield pdf


def stem_vocabulary(df: DataFrame, tokens) -> DataFrame:
    """C8 vocabulary job: (token, n, stem) over the distinct tokens of an array column."""
    t = tokens if not isinstance(tokens, str) else F.col(tokens)
    toks = df.select(F.explode_outer(t).alias("token")).where(F.col("token").isNotNull())
    distinct = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return distinct.mapInPandas(_stem_batches, "token string, n long, stem string")
