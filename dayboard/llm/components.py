"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stash


def connected_components(links: DataFrame, stash: Stash) -> DataFrame:
    """``links(a, b)`` -> ``(id, label)``: each linked node with the smallest id of its component.

    Each round replaces the links by links to local minima; every step is a partial aggregate and a join whose
    hot side Spark can split, and the links never leave the executors.  No links give no rows.
    """
    edges = stash.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash.put(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stash.drop(edges)
        edges = after
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
        seen = now
