"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum and a join, so no component lands in one task; edges are written between steps, and so are the
minima of large-star, where the root of a large component meets all its nodes: a join of two plain shuffles can be split there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(n, m): each node a of `edges` with the least of itself and its neighbours b."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    """Edges (a, b), a > b. Large-star links the greater neighbours of each node to its least neighbour or itself; small-star
    the smaller neighbours and the node itself."""
    both = edges if small else _both(edges)
    joined = both.join(least, F.col("a") == F.col("n"), "inner")
    if small:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    else:
        new = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return new.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (columns a, b; any order, repeats and loops allowed): root is the least
    node of the component. Nodes without an edge have no row."""
    held = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = materialize(held, name)
    state = None
    for _ in range(most):
        last, least = held, materialize(_least(_both(held)), name)
        large = _star(last, least, small=False)
        held = materialize(_star(large, _least(large), small=True), name)
        discard(last, least)
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {most} rounds")
