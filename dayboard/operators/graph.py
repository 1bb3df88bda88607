"""Crawls over landed links: bounded rounds of joins, each round's rows written so that no round is computed again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions

#: Rows up to which the first of an order are taken by Spark's own top rows.
MOST_SORTED = 10_000


def _cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, in the shared folder of ``spark.checkpoint.dir``; a folder of its own in local mode."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="dayboard-"))
    return df.checkpoint()


def crawl(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``(node, depth)`` of nodes within so many links of ``start(node)``; each node once, at its least depth.

    The frontier is a join and an anti-join a round, so a node that was seen is never expanded again; rounds end when
    nothing new is found.
    """
    seen = frontier = _cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def crawl_in_order(start: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``(node, place)`` of the first ``most`` nodes that a queue reads, from 0.

    The queue begins with ``start(node, place)`` and takes the ends of ``links(src, dst, place)`` of each node that it
    reads, in order of their places, once each.  A node's own place follows from its depth, the place of the node that
    led to it first, and the link's place there; so a level is ordered and numbered at once, and one that goes beyond
    the bound is cut in that order.  Nodes without links are read too, whether or not they landed; nulls are not.
    """
    found = start.where("node is not null").groupBy("node").agg(F.min(F.struct(F.lit(-1).cast("long").alias("led"), F.col("place").cast("long").alias("link"))).alias("by"))
    seen, size = None, 0
    while size < most:
        level = found.select("node", "by.led", "by.link")
        left = most - size
        if left <= MOST_SORTED:
            level = level.orderBy("led", "link", "node").limit(left)
            level = level.withColumn("position", F.row_number().over(Window.orderBy("led", "link", "node")) - 1)  # of the rows that are left
        else:
            level = positions(level, ["led", "link", "node"]).where(F.col("position") < left)
        level = _cut(level.select("node", (F.col("position") + size).cast("long").alias("place")))
        n = level.count()
        if not n:
            break
        seen, size = level if seen is None else seen.unionByName(level), size + n
        step = links.join(level.select(F.col("node").alias("src"), F.col("place").alias("led")), "src").where("dst is not null")
        found = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("led", F.col("place").cast("long").alias("link"))).alias("by"))
        found = found.join(seen.select("node"), "node", "left_anti")
    return seen if seen is not None else start.select("node", F.col("place").cast("long").alias("place")).limit(0)


def next_links(start: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``(start, depth, node)``: the pages that each ``start(node)`` leads to, following ``links(src, dst)`` of one next
    page each, at most ``most`` pages with the first; a chain stops before a page that it has visited."""
    at = _cut(start.select(F.col("node").alias("start"), F.lit(1).alias("depth"), "node", F.array("node").alias("seen")))
    out = at
    for d in range(2, most + 1):
        step = at.join(links, at["node"] == links["src"]).where(~F.array_contains("seen", F.col("dst")))
        at = _cut(step.select("start", F.lit(d).alias("depth"), F.col("dst").alias("node"), F.concat("seen", F.array("dst")).alias("seen")))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.drop("seen")
