"""Connected components of large graphs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the smallest node reachable. Nodes without edges don't appear.

    Each step moves neighbours to a node's smallest neighbour. A node's minimum is an aggregate that combines before
    the shuffle, and the join that spreads it has one row per node on one side, so a hub with a third of all edges
    is split by adaptive execution. Every round is written to the shared folder. Ends when a round changes nothing.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, was = written(edges, "components"), None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v")).distinct()
        was = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        dropped(last)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
