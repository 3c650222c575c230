"""Connected components by contraction, in DataFrames; no step gathers a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long. node long, component long (the smallest node reachable) for every node of an edge.

    Each round points every node of the contracted graph to its smallest neighbour, follows the pointers to their ends by
    doubling, and contracts. A round at least halves the nodes that still have edges, so rounds grow as the logarithm.
    Sums over a node's edges are combined before the shuffle; joins are on a node's own row, so that a hub's edges may be split.
    """
    both = edges.where("a <> b").select("a", "b").distinct()
    live = written(both.union(both.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = written(live.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not live.isEmpty():
        to = written(live.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")), "pointers")
        while True:
            on = to.alias("x").join(to.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.b") != F.col("y.b")).alias("moved"))
            on = written(on, "pointers")
            to = on.select("a", "b")
            if on.where("moved").isEmpty():
                break
        new = labels.alias("l").join(to.alias("t"), F.col("l.component") == F.col("t.a"), "left").select("l.node", F.coalesce("t.b", "l.component").alias("component"))
        labels = written(new, "labels")
        x, y = to.toDF("a", "na"), to.toDF("b", "nb")
        live = written(live.join(x, "a").join(y, "b").where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "edges")
    return labels
