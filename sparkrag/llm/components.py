"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges stay a distributed table from start to end: each round takes, at each node, the least neighbour (an
aggregation that combines before its shuffle) and hangs the other neighbours on it. The number of rounds grows with
the logarithm of the longest path. Each round's edges are written to the shared folder, which ends their lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean

MOST_HELD = 1 << 20  # nodes that a task holds while it joins edges


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): for each u with least m among u and its v, the pairs (v, m) and (u, m)."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (m, v), m < v, that connect what ``edges`` connects within each task: fewer than the task has nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while up.get(root, root) != root:
                root = up[root]
            while x != root:
                up[x], x = root, up.get(x, x)
            return root

        def out() -> pa.RecordBatch:
            pairs = [(r, x) for x in up if (r := find(x)) != x]
            return pa.record_batch([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["m", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    up.setdefault(min(a, b), min(a, b))
            if len(up) > MOST_HELD:  # memory stays bounded; what was found so far goes on
                yield out()
                up = {}
        yield out()

    return edges.mapInArrow(lean(run), "m long, v long")


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", reduced: bool = False) -> DataFrame:
    """(node, component) for every node that an edge touches; the component is its least node.

    Edges are first thinned out within each task, unless they are ``reduced`` already.
    """
    now = edges.select(F.least(a, b).alias("m"), F.greatest(a, b).alias("v")).where("m < v")
    now = (now if reduced else _forest(now)).distinct()
    now = cut(spark, now, "edges")
    while True:
        ends = now.select(F.col("v").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("m").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        # stars: no node hangs on two others, or on one and holds others itself
        seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if seen.where("below + above > 1").isEmpty():
            return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
        both = now.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.select(F.col("m").alias("u"), "v"))
        large = _star(both).where("v > u").select("v", "m").distinct()
        down = large.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = _star(down)
        small = stars.where("v > m").select("v", "m").unionByName(stars.select(F.col("u").alias("v"), "m")).distinct()
        now = cut(spark, small, "edges")
