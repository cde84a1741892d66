"""Connected components for similarity groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.tables import shared_folder


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node that edges (a, b) reach.

    Labels start as the node's own; each round takes the least label next to a node and then the label of that label, so paths halve;
    rounds are checkpointed in the cluster's shared folder. Ends when no label changes.
    """
    shared_folder(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(near, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        after = lower.join(up, "component", "left").select("node", F.least("component", F.coalesce("upper", "component")).alias("component"), "old").checkpoint()
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels
