"""The queries over whole tables, against brute force: events whose id no subset holds, crowded places, all nations."""

from collections import Counter, defaultdict

import numpy as np

from latticework import catalog_queries as Q
from latticework.operators import paths as P
from latticework.operators import spatial as SP
from latticework.plans.graph import PropertyGraph


def test_paths_start_everywhere(spark):
    sizes = [45, 3, 1]
    ids = iter(i for i in range(1, 1000) if i % 50)
    chains = [[next(ids) for _ in range(n)] for n in sizes]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    g = PropertyGraph(spark).add_nodes("Event", spark.createDataFrame([(i,) for c in chains for i in c], "id long"))
    g.add_edges("NEXT", "Event", "Event", spark.createDataFrame(edges, "src long, dst long"))
    hops = Counter(j - i for n in sizes for i in range(n) for j in range(i, n))
    pairs = lambda frame: {tuple(r) for r in frame.collect()}
    assert pairs(Q.var_length_paths(g)) == {(h, hops[h]) for h in (1, 2, 3)}
    assert Q.var_length_from_zero(g).first()[0] == hops[0] + hops[1] + hops[2]
    assert pairs(Q.reachable_within(g)) == {(c[i], min(10, n - 1 - i)) for n, c in zip(sizes, chains) for i in range(n - 1)}
    assert pairs(Q.shortest_path_length(g)) == {(h, hops[h]) for h in range(1, 21)}


def brute_dbscan(points, eps, least):
    near = {a: {b for b in points if a != b and sum((p - q) ** 2 for p, q in zip(points[a], points[b])) <= eps * eps} for a in points}
    cores = {a for a in points if len(near[a]) >= least}
    cluster = {a: a for a in cores}
    changed = True
    while changed:
        changed = False
        for a in cores:
            low = min(cluster[b] for b in (near[a] & cores) | {a})
            changed, cluster[a] = changed or low < cluster[a], low
    return {a: cluster.get(a, min((cluster[b] for b in near[a] & cores), default=-1)) for a in points}


def test_dbscan_with_hot_places(spark):
    rng = np.random.default_rng(1)
    xy = rng.integers(0, 40, (150, 2)).tolist() + [[60, 60]] * 3 + [[80, 80]] * 2 + [[7, 7]] * 30
    points = {k: tuple(map(float, p)) for k, p in enumerate(xy, 1)}
    for least in (1, 2, 5):
        got = SP.dbscan(spark.createDataFrame([(k, *p) for k, p in points.items()] + [(900, None, 1.0)], "id long, x double, y double"), 2.5, least)
        assert {r.id: r.cluster for r in got.collect()} == brute_dbscan(points, 2.5, least) | {900: -1}


def test_copies_of_a_place_never_meet(spark):
    got = SP.dbscan(spark.range(100_000).selectExpr("id", "0.5D as x", "0.5D as y"), 1.0, 2)
    assert got.groupBy("cluster").count().collect() == [(0, 100_000)]


def test_distances_from_all(spark):
    rng = np.random.default_rng(2)
    edges = sorted({(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 12, 20), rng.integers(0, 12, 20), rng.integers(1, 6, 20))})
    edges = [(a, b, c) for (a, b), c in {(a, b): c for a, b, c in edges}.items()]
    far, paths = defaultdict(dict), defaultdict(dict)
    for s in range(12):
        far[s] = {s: 0}
        for _ in range(12):
            for a, b, c in edges:
                if a in far[s]:
                    far[s][b] = min(far[s].get(b, 1e9), far[s][a] + c)
        level, paths[s], h = {s: 1}, {s: (0, 1)}, 0
        while level:
            h += 1
            step = Counter()
            for a, b, _ in edges:
                if a in level and b not in paths[s]:
                    step[b] += level[a]
            level = step
            paths[s].update({b: (h, n) for b, n in step.items()})
    frame = spark.createDataFrame(edges, "src long, dst long, cost long")
    assert {tuple(r) for r in P.weighted_distances(spark.range(12), frame, "cost").select("source", "id", "distance").collect()} == {(s, x, d) for s in far for x, d in far[s].items()}
    assert {(r.source, r.id, r.hops, r.paths) for r in P.shortest_path_counts(spark.range(12), frame.select("src", "dst")).collect()} == {(s, x, *v) for s in paths for x, v in paths[s].items()}


def test_path_lengths_are_counted_to_the_end(spark):
    edges = [(i, i + 1) for i in range(1, 45)] + [(51, 52), (52, 53)]
    g = PropertyGraph(spark).add_nodes("Event", spark.createDataFrame([(i,) for i in [*range(1, 46), 51, 52, 53]], "id long"))
    g.add_edges("NEXT", "Event", "Event", spark.createDataFrame(edges, "src long, dst long"))
    hops = Counter(j - i for n in (45, 3) for i in range(n) for j in range(i + 1, n))
    assert {tuple(r) for r in Q.all_path_lengths(g).collect()} == set(hops.items())
    assert "21" not in Q.ORACLE["shortest_path_length"]
