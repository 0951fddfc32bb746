"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint); label is the least node of the
    component. Each round takes the least label among a node's neighbours and then the label of
    that label, so paths shorten by half at least; every round's table is written."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")) \
                   .agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = stored(low.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").limit(1).count() == 0:
            return labels
