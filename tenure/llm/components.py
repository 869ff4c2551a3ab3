"""Connected components of a graph given as edges, by label passing with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Every round lowers each node's label to the smallest label among its
    neighbours and then to its label's own label, which halves the distance to
    the root, so chains take about the logarithm of their length in rounds.
    Labels and edges of a round are read from checkpoints: both sides of each
    join shuffle plainly and AQE can split the partition of a node that a
    large part of all edges meet.  Null ends and loops are ignored.
    """
    one = edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(one.union(one.select("v", "u")).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label"))
                 .select(F.col("u").alias("node"), "label"))
    while True:
        passed = (both.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("label").alias("other")))
        lower = cut(labels.join(passed, F.col("node") == F.col("v"), "left")
                    .select("node", F.least("label", "other").alias("label"), F.col("label").alias("was")))
        roots = lower.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = cut(lower.join(roots, F.col("label") == F.col("root"), "left")
                     .select("node", F.least("label", "above").alias("label"), "was"))
        if jumped.filter("label <> was").isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped.drop("was")
