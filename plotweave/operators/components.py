"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotweave.session import cut


def _attach_to_minimum(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of them and itself.

    With `smaller_only` only the neighbours below the node are moved, else those above it. The
    minimum per node combines map-side, so a hub is one partial row per task.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both.filter(F.col("b") < F.col("a")) if smaller_only else both
    low = side.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.filter(F.col("b") < F.col("a")) if smaller_only else both.filter(F.col("b") > F.col("a"))
    linked = moved.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if smaller_only:
        linked = linked.union(low.select("a", F.col("m").alias("b")))
    return linked.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for every node on an edge `(a, b)`; root is the smallest node reached.

    Nodes may be of any type that can be ordered, structs included.

    The number of rounds grows with the logarithm of the component size, not with its length.
    Every round is written to the shared folder, which also cuts the lineage.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    current = cut(current, "components")
    mark = _digest(current)
    while True:
        current = cut(_attach_to_minimum(_attach_to_minimum(current, False), True), "components")
        after = _digest(current)
        if after == mark:
            break
        mark = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(*[F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in range(2)], F.count("*")).first()
    return tuple(row)
