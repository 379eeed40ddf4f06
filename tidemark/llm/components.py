"""Connected components of an edge table by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step is an aggregation with map-side
combine and an equi-join that adaptive execution may split, so that a hub with a third of all edges is no hot task.
Nothing is collected but one row of counters for each round. At most ``FEW`` edges, for which every round would cost many
tasks and files of next to nothing, are united by the driver instead, with the same result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Edges (16 bytes each) that the driver unites; more go through rounds.
FEW = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("k"), "m")
    larger = both.where("v > u")
    return larger.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = edges.join(least, F.col("a") == F.col("k")).where("b <> m")
    stars = least.select(F.col("k").alias("a"), F.col("m").alias("b"))
    moved = moved.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return stars.unionByName(moved).distinct()


def _united(edges: DataFrame) -> DataFrame:
    """Components of a few edges, a > b, by union-find in the driver: every root is the least of its nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    ends = edges.toArrow()
    for x, y in zip(ends.column("a").to_pylist(), ends.column("b").to_pylist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    found = {"node": list(parent), "component": list(map(root, parent))}
    return edges.sparkSession.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()}))


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges(a, b)``, 64-bit ids; component: the smallest id reachable.

    Null ends are ignored, loops and repeated edges change nothing, no edges give no rows. A node without edges is not
    returned: it is its own component. Above ``few`` edges rounds go on until one changes nothing; their number grows with
    the logarithm of the longest path. The result does not depend on ``few`` and is cheap to read again.
    """
    nodes = edges.where("a is not null and b is not null")
    current = cut(nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if current.count() <= few:
        return _united(current)
    current = cut(current.distinct())
    before = None
    while True:
        now = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
        # Both steps keep the order a > b; large-star sends a node's larger neighbours to its least one.
        current = cut(_small_star(cut(_large_star(current))))
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return cut(current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
