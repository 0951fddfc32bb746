"""Summaries of scored tables (ids H1-H4, H8).

One aggregation with a rollup gives the per-label rows and the total row in a single
job (partial aggregation map-side, one small shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

TOTAL_LABEL = "ALL"


def sentiment_summary(scored: DataFrame, label: str = "sentiment", score: str = "polarity") -> DataFrame:
    """H1-H4: per label and overall (label ``ALL``): rows analysed and mean score
    (3 decimals, 0.0 when empty), largest label first."""
    agg = (scored.rollup(label)
           .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("avg_score"),
                F.grouping(label).alias("g")))
    return (agg.select(F.when(F.col("g") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col(label)).alias(label),
                       F.col("n_rows"),
                       F.coalesce(T.round3(F.col("avg_score"), is_average=True), F.lit(0.0)).alias("mean_score"))
            .orderBy(F.desc("n_rows"), label))


def list_sorted(df: DataFrame, name: str) -> DataFrame:
    """H8: listing sorted by name."""
    return df.orderBy(name)
