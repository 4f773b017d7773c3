"""Crawling without a network: breadth first over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crawl(edges: DataFrame, seeds: DataFrame, depth: int, pages: int | None = None) -> DataFrame:
    """(node, depth): each node at the fewest steps from a seed; edges are (a, b).

    One join a step, and nodes that were seen are taken out, so no node is read twice. With
    ``pages`` the first so many by depth and name are kept.
    """
    new = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    seen = new
    for step in range(1, depth + 1):
        reached = new.join(edges, new["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        new = reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(new)
    return seen if pages is None else seen.orderBy("depth", "node").limit(pages)
