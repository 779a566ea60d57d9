"""Connected components of a graph that is only ever held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges(a, b). Each round takes the least label around a node and then that label's own label, so rounds grow with the logarithm of a path's length."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("at_b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("at_b").alias("around"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "around").alias("new"))
        jump = moved.join(labels.select(F.col("node").alias("new"), F.col("label").alias("next")), "new").select("node", "label", F.least("new", "next").alias("new"))
        step = materialise(jump, "labels")
        changed = step.filter("new <> label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
