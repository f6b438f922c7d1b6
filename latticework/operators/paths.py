"""Path counting, weighted distances, neighbourhoods and betweenness, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.algorithms import both_ways, hops_from
from latticework.storage import Scratch


def shortest_path_counts(sources: DataFrame, edges: DataFrame, most: int = 1_000) -> DataFrame:
    """``(source, id, hops, paths)``: how many shortest directed paths lead to each node; parallel edges count each."""
    scratch = Scratch(sources.sparkSession)
    step = scratch.put(edges.groupBy("src", "dst").agg(F.count("*").alias("w")))
    seen = front = scratch.put(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"), F.lit(1).cast("long").alias("paths")))
    for depth in range(1, most + 1):
        near = front.join(step, F.col("id") == F.col("src")).groupBy("source", "dst").agg(F.sum(F.col("paths") * F.col("w")).alias("paths"))
        new = near.select("source", F.col("dst").alias("id"), F.lit(depth).alias("hops"), "paths").join(seen.select("source", "id"), ["source", "id"], "left_anti")
        front = scratch.put(new.select("source", "id", "hops", "paths"))
        if front.isEmpty():
            break
        seen = scratch.put(seen.unionByName(front))
    return seen


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """``(id, score)`` on simple undirected edges (Brandes): path counts forward, dependencies back, all sources at once.

    With ``sources`` a sample stands for all, scaled up.
    """
    scratch = Scratch(nodes.sparkSession)
    around = scratch.put(both_ways(edges))
    starts = nodes.select("id") if sources is None else sources.select("id")
    counts = scratch.put(shortest_path_counts(starts, around))
    deepest = counts.agg(F.max("hops")).first()[0] or 0
    delta = None
    parts = []
    for depth in range(deepest, 0, -1):
        here = counts.where(F.col("hops") == depth)
        here = here.withColumn("delta", F.lit(0.0)) if delta is None else here.join(delta, ["source", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        here = scratch.put(here.select("source", "id", "paths", "delta"))
        parts.append(here.select("id", "delta"))
        above = counts.where(F.col("hops") == depth - 1).select("source", F.col("id").alias("up"), F.col("paths").alias("up_paths"))
        back = here.join(around, F.col("id") == F.col("src")).join(above, (F.col("dst") == F.col("up")) & (here["source"] == above["source"])).drop(above["source"])
        delta = scratch.put(back.groupBy("source", F.col("up").alias("id")).agg(F.sum(F.col("up_paths") / F.col("paths") * (1 + F.col("delta"))).alias("delta")))
    n, k = nodes.count(), starts.count()
    scale = (n / k if k else 0.0) / 2
    if normalized:
        scale = scale * 2 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    total = None
    for p in parts:
        total = p if total is None else total.unionByName(p)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("score"))
    total = total.groupBy("id").agg((F.sum("delta") * scale).alias("score"))
    return nodes.select("id").join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def weighted_distances(sources: DataFrame, edges: DataFrame, weight: str, most: int = 1_000) -> DataFrame:
    """``(source, id, distance)`` by relaxation until nothing improves; a missing weight is 1, a negative one fails."""
    scratch = Scratch(sources.sparkSession)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    step = scratch.put(edges.groupBy("src", "dst").agg(F.min(F.when(w < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(w)).alias("w")))
    best = front = scratch.put(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")))
    for _ in range(most):
        near = front.join(step, F.col("id") == F.col("src")).groupBy("source", "dst").agg(F.min(F.col("distance") + F.col("w")).alias("found")).withColumnRenamed("dst", "id")
        front = scratch.put(near.join(best, ["source", "id"], "left").where("distance is null or found < distance - 1e-12").select("source", "id", F.col("found").alias("distance")))
        if front.isEmpty():
            break
        best = scratch.put(best.unionByName(front).groupBy("source", "id").agg(F.min("distance").alias("distance")))
    return best


def expand(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(id)`` within so many hops, edges taken both ways."""
    step = both_ways(edges)
    out = start.select("id").distinct()
    for _ in range(hops):
        out = out.unionByName(step.join(out, step["src"] == out["id"], "left_semi").select(F.col("dst").alias("id"))).distinct()
    return out


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes(id)``."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def shortest_paths(pairs: DataFrame, edges: DataFrame, directed: bool = True, most: int = 100) -> DataFrame:
    """``(a, b, hops, path)``: one shortest path of each connected pair, through the least parents; loops over hops, not over pairs."""
    found = hops_from(pairs.select(F.col("a").alias("id")).distinct(), edges, directed, most)
    now = pairs.select("a", "b").distinct().join(found.select(F.col("source").alias("a"), F.col("id").alias("b"), "hops", "parent"), ["a", "b"])
    now = now.select("a", "b", "hops", F.array("b").alias("path"), F.col("parent").alias("up"))
    scratch = Scratch(pairs.sparkSession)
    steps = scratch.put(found.select(F.col("source").alias("_a"), F.col("id").alias("_id"), F.col("parent").alias("_parent")))
    now = scratch.put(now)
    for _ in range(most):
        if now.where("up is not null").isEmpty():
            break
        joined = now.join(steps, (F.col("a") == F.col("_a")) & (F.col("up") == F.col("_id")), "left")
        path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.array("up"), "path"))
        now = scratch.put(joined.select("a", "b", "hops", path.alias("path"), F.col("_parent").alias("up")))
    return now.drop("up")


def diameter(nodes: DataFrame, edges: DataFrame) -> int:
    """The greatest eccentricity within components; all pairs are met, so for graphs of bounded size."""
    return hops_from(nodes.select("id"), edges, directed=False).agg(F.max("hops")).first()[0] or 0
