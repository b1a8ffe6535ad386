"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigward import session

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of each node of the edges (a, b).

    Labels pass along edges and then jump to their label's label, so that the rounds grow with the logarithm of the longest path.
    Each round is a written table; nodes with many edges are combined before the shuffle.
    """
    both = session.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = session.written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        stepped = session.written(stepped, "stepped")
        of = stepped.select(F.col("node").alias("at"), F.col("component").alias("up"))
        jumped = stepped.join(of, F.col("component") == F.col("at"), "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component"))
        labels = session.written(jumped, "labels")
        if labels.where("old <> component").isEmpty():
            break
        labels = labels.select("node", "component")
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", "component")
