"""Connected components of a graph given as a table of edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import discard, written


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, component (the smallest node that can be reached) for each node of edges (a, b: long), as a written table.

    Each round takes the least label among neighbours, then the label of the label; both are joins and aggregations with
    partial sums, and each round is a table in the shared folder, which the next replaces. In every join the side of labels
    has one row for a key, so rows grow with the edges only, and Spark may split the other side of a hot key.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = written(labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component")), "labels")
        discard(labels)
        far = lower.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = written(lower.join(far, "component", "left").select("node", "before", F.coalesce("far", "component").alias("component")), "labels")
        discard(lower)
        if labels.where("component <> before").limit(1).count() == 0:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
