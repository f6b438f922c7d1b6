"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.storage import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether all edges go from a leaf to a root, one a leaf: nothing would move any more."""
    row = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("leaves")).first()
    return row["n"] == row["leaves"] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable type to ``(node, root)``: root is the least node reachable.

    Self-loops and repeated or null-ended edges are ignored; nodes without an edge don't appear. Each round is
    two shuffled star steps written to shared storage; minima are pre-aggregated, and the neighbours of a hub (two ids
    a row) pass through one task as a stream, and the number of rounds grows with the logarithm of the size. Raises after ``max_rounds``.
    """
    now = scratch.put(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _settled(now):
            break
        new = scratch.put(_small_star(_large_star(now)))
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
