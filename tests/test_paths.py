from itertools import combinations

from pyspark.sql import functions as F

from latticework.operators import paths as P
from latticework.operators import spatial as SP
from latticework.plans import compute as C
from latticework.plans.graph import PropertyGraph

EDGES = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (3, 5), (5, 6), (7, 8)]


def frame(spark):
    return spark.range(9), spark.createDataFrame(EDGES, "src long, dst long")


def brute_betweenness(n, edges):
    around = {k: set() for k in range(n)}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    score = dict.fromkeys(range(n), 0.0)
    for s, t in combinations(range(n), 2):
        paths, found = [[s]], []
        while paths and not found:
            found = [p for p in paths if p[-1] == t]
            paths = [[*p, x] for p in paths for x in around[p[-1]] if x not in p] if not found else []
        for p in found:
            for x in p[1:-1]:
                score[x] += 1 / len(found)
    return {k: round(v * 2 / ((n - 1) * (n - 2)), 9) for k, v in score.items()}


def test_betweenness(spark):
    nodes, edges = frame(spark)
    got = {r["id"]: round(r["score"], 9) for r in P.betweenness(nodes, edges).collect()}
    assert got == brute_betweenness(9, EDGES)


def test_paths(spark):
    nodes, edges = frame(spark)
    one = nodes.where("id = 0")
    assert {(r["id"], r["hops"], r["paths"]) for r in P.shortest_path_counts(one, edges).collect()} == {(0, 0, 1), (1, 1, 1), (4, 1, 1), (2, 2, 1), (3, 2, 1), (5, 3, 1), (6, 4, 1)}
    cost = edges.withColumn("w", F.when((F.col("src") == 0) & (F.col("dst") == 4), 9).otherwise(F.lit(None)))
    assert {(r["id"], r["distance"]) for r in P.weighted_distances(one, cost, "w").collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 9), (5, 4), (6, 5)}
    assert {r["id"] for r in P.expand(nodes.where("id = 3"), edges, 1).collect()} == {2, 3, 4, 5}
    assert P.induced(edges, nodes.where("id < 3")).count() == 2


def test_clusters_and_areas(spark):
    pts = [(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 1.0, 0.0), (4, 5.0, 5.0), (5, 1.9, 0.0), (6, -3.0, 0.0)]
    got = {r["id"]: r["cluster"] for r in SP.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), 1.0, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 4: -1, 6: -1}
    ring = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 4.0}, {"lat": 4.0, "lon": 0.0}]
    areas = spark.createDataFrame([(1, ring)], "id long, ring array<struct<lat: double, lon: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, -1.0, 1.0)], "id long, lat double, lon double")
    assert SP.points_in_areas(points, areas).collect() == [(1, 1)]


def test_calendar(spark):
    g = PropertyGraph(spark).add_nodes("E", spark.createDataFrame([(1, "2024-01-30"), (2, "2024-02-02"), (3, None)], "id long, day string"))
    C.calendar(g, "E", "day")
    assert g.nodes["Date"].count() == 4 and g.nodes["Month"].count() == 2 and g.all_edges("NEXT_DAY").count() == 3 and g.all_edges("ON_DATE").count() == 2
