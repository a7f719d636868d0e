"""Connected components of an edge table by smallest-label propagation.

Each round sends labels over edges, then jumps every label to its own label
(pointer jumping), so stars settle in two rounds and paths in about the
logarithm of their length. Labels are written to the shared folder each round;
nothing but the count of changed labels reaches the driver. A node with very
many edges is a hot join key only on the side that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """``edges`` (a, b) -> (id, label): the smallest id of each node's component, for nodes that have an edge. ``made`` gets the folders that it wrote, the result's among them."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), made)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), made)
    while True:
        best = both.join(labels, both.a == labels.id).groupBy("b").agg(F.min("label").alias("near"))
        old = labels.select(F.col("id"), F.col("label").alias("old"))
        new = old.join(best, old.id == best.b).select("id", "old", F.least("old", "near").alias("label"))
        up = labels.select(F.col("id").alias("up_id"), F.col("label").alias("up"))
        new = stored(new.join(up, new.label == up.up_id).select("id", "old", F.least("label", "up").alias("label")), made)
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels
