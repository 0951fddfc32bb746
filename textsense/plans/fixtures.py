"""Small literal inputs shared by the Spark queries and their SQL oracles.

The driver text is invented, so an English lexicon would score almost nothing; this lexicon
uses tokens that do occur in ``documents`` (see SURVEY §7) plus a few French, German and
Spanish ones. It is an input table, like any lexicon a user would supply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lexicon import LEXICON_SCHEMA

# term, polarity, intensity, is_modifier, is_negation
LEXICON_ROWS = [
    ("rewh", 0.7, 1.0, False, False),
    ("orre", 0.5, 1.0, False, False),
    ("inoran", 0.3, 1.0, False, False),
    ("thatin", -0.6, 1.0, False, False),
    ("ononst", -0.4, 1.0, False, False),
    ("hehely", -0.8, 1.0, False, False),
    ("orantion", 0.4, 1.0, False, False),
    ("is", None, 1.3, True, False),
    ("ha", 0.2, 1.3, True, False),
    ("from", None, 1.0, False, True),
    ("que", 0.35, 1.0, False, False),
    ("des", -0.45, 1.0, False, False),
    ("une", 0.6, 1.0, False, False),
    ("pas", None, 1.0, False, True),
    ("der", -0.3, 1.0, False, False),
    ("und", 0.25, 1.0, False, False),
    ("sich", None, 1.5, True, False),
    ("nicht", None, 1.0, False, True),
    ("los", -0.55, 1.0, False, False),
    ("del", 0.45, 1.0, False, False),
    ("por", None, 0.8, True, False),
]


def lexicon_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, LEXICON_SCHEMA)


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(float(v)) if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def lexicon_sql() -> str:
    rows = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in LEXICON_ROWS)
    return (f"(SELECT * FROM (VALUES {rows}) AS lx(term, polarity, intensity, is_modifier, is_negation))")
