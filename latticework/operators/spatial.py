"""Joins and clusters of points, over grid cells so that only neighbours meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.components import connected_components
from latticework.storage import Scratch


def contains(lat, lon, ring) -> Column:
    """Ray casting in a column of corner structs ``(lat, lon)``."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.size(ring) - 1))
    edge = F.zip_with(ring, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(edge, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def points_in_areas(points: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """``(point, area)`` ids: ``points(id, lat, lon)`` within ``areas(id, ring array<struct<lat, lon>>)``.

    Both sides go to grid cells of ``cell`` degrees (an area to all that its box covers), meet there and are tested exactly.
    """
    grid = lambda c: F.floor(c / cell)
    sides = [f(F.col(f"ring.{k}")).alias(f"{n}_{k}") for k in ("lat", "lon") for n, f in (("low", F.array_min), ("high", F.array_max))]
    box = areas.select(F.col("id").alias("area"), "ring", *sides)
    cells = box.withColumn("x", F.explode(F.sequence(grid(F.col("low_lat")), grid(F.col("high_lat"))))).withColumn("y", F.explode(F.sequence(grid(F.col("low_lon")), grid(F.col("high_lon")))))
    placed = points.select(F.col("id").alias("point"), "lat", "lon", grid(F.col("lat")).alias("x"), grid(F.col("lon")).alias("y"))
    return placed.join(cells, ["x", "y"]).where(contains(F.col("lat"), F.col("lon"), F.col("ring"))).select("point", "area")


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``(id, cluster)`` of ``points(id, x, y)``: the least core id of the cluster, -1 for noise.

    A core has ``least`` other points within ``eps``; cores in reach are one cluster (connected components), and other
    points take the least cluster of a core in reach. Points of one place are one row with a count, so copies never
    meet each other. Cells are ``eps`` wide, so a place meets nine of them. A point without coordinates is noise.
    """
    scratch = Scratch(points.sparkSession)
    places = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    here = scratch.put(places.select("id", "x", "y", "w", F.floor(F.col("x") / eps).alias("i"), F.floor(F.col("y") / eps).alias("j")))
    around = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = here.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(around).alias("c")).select("a", "ax", "ay", "c.i", "c.j")
    near = spread.join(here, ["i", "j"]).where((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= eps * eps)
    near = scratch.put(near.select("a", F.col("id").alias("b"), "w"))
    cores = scratch.put(near.groupBy("a").agg((F.sum("w") - 1).alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id")))
    linked = near.where("a <> b").join(cores.withColumnRenamed("id", "a"), "a", "left_semi")
    among = linked.join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    roots = connected_components(among.selectExpr("a as u", "b as v"), scratch)
    named = scratch.put(cores.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster")))
    edge = linked.join(named.selectExpr("id as a", "cluster"), "a").groupBy(F.col("b").alias("id")).agg(F.min("cluster").alias("border"))
    found = here.select("id", "x", "y").join(named, "id", "left").join(edge, "id", "left").select("x", "y", F.coalesce("cluster", "border").alias("cluster"))
    return points.select("id", "x", "y").join(found, ["x", "y"], "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
