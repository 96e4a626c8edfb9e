"""Connected components of a graph given as an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ringside.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the least node that it is joined to.

    Each round takes the least label among the neighbours and then that label's own label, so the
    reach doubles; it ends when no label changes. Only narrow rows are shuffled, partial minima first.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("c")).select("node", F.least("node", "c").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        own = labels.select(F.col("node").alias("new"), F.col("component").alias("further"))
        moved = store(least.join(own, "new").select("node", F.least("new", "further").alias("component"),
                                                    (F.least("new", "further") != F.col("old")).alias("changed")), "labels")
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels
