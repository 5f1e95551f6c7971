"""Connected components as joins and aggregations over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.sources.workspace import materialize


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for edges (a, b): component is the least node reachable.

    Each round takes the least label among the neighbours and then the label of
    that label, so a path halves. ``edges`` should be a written table, as every round
    reads it. Both sides of each join then are, so a node with very many neighbours is
    split by Spark, and its least label is found by partial aggregation. Loops and
    repeated edges are harmless; no edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jumps = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        moved = lowered.join(jumps, "low", "left").select(
            "node", F.least("low", F.coalesce("jump", "low")).alias("component"),
            (F.least("low", F.coalesce("jump", "low")) < F.col("component")).alias("moved"),
        )
        labels = materialize(moved, "labels")
        if labels.where("moved").limit(1).count() == 0:
            return labels.drop("moved")
