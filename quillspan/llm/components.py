"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import cut


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included. Stored, so that the join with it may split a node of very many edges."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "smallest")


def _settled(edges: DataFrame) -> bool:
    """Whether each node points to one other that points to none."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out > 1 or out = 1 and met = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for each node of edges (a, b: bigint), by turns of large and small stars until each node points to its root.

    What is stored for each turn is no larger than the edges; nothing but the end of the turns reaches the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        low = _smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small, "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
