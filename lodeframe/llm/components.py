"""Connected components by alternating large and small stars, in DataFrame operations.

Each round takes the least neighbour of every node, which is combined before the
shuffle, and points edges at it; a node with very many neighbours is a skewed join
key, which adaptive execution splits. Rounds grow with the logarithm of the longest
path. Every round is written to the shared folder, so no lineage grows and a lost
executor costs one round at the most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import passing, written


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union and find over the edges of one task; the least node names its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 0) -> DataFrame:
    """(node, component) for every node of an edge: component is the least node that is reached.

    Edges go both ways; repeated ones, loops and edges with a null end are allowed and
    change nothing but that a loop names its node. No edges give no rows. Up to
    ``one_task`` edges between integers are merged in a single task, with the same result.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    if one_task and ends.count() <= one_task:
        return ends.coalesce(1).mapInArrow(_merged, "node long, component long")
    with passing(edges.sparkSession):
        now = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
        before = None
        while True:
            # Large star: what is above a node points at the least of all its neighbours.
            both = now.union(now.select("v", "u")).toDF("u", "v")
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            loops = now.where("u = v")
            large = up.union(loops).distinct()
            # Small star: what is below a node, and the node itself, points at the least below it.
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = written(down.union(low.select("u", F.col("m").alias("v"))).distinct(), "components")
            state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if state == before:
                break
            before = state
        found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
        return written(found.union(roots).groupBy("node").agg(F.min("component").alias("component")), "components", lasting=True)
