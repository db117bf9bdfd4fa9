"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _star(edges: DataFrame, mirrored: bool) -> DataFrame:
    """Connect each vertex's neighbours to the least vertex of its neighbourhood.

    mirrored: the large star (every neighbour counts, only larger ones move); else the small star
    (only smaller neighbours count). The least neighbour is found by a partially aggregated group
    and joined back, so that a vertex with very many neighbours is never gathered in one task.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if mirrored:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if mirrored:
        moved = joined.where(F.col("v") > F.col("u"))
    else:
        moved = joined.union(least.select("u", F.col("u").alias("v"), "m"))
    pairs = moved.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of the edge table (a, b); component is the least vertex reachable.

    Self-loops and repeated edges are allowed; vertices without an edge to another one are not returned.
    An empty edge table gives an empty result. Each round is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        large = materialize(_star(now, True), "edges")
        after = materialize(_star(large, False), "edges")
        drop_table(large)
        drop_table(now)
        now = after
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
