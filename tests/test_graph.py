import pytest
from pyspark.sql import functions as F

from latticework.functions import scalars as S
from latticework.operators import algorithms as A
from latticework.operators import rules as R
from latticework.operators.selection import Selection
from latticework.plans.graph import PropertyGraph
from latticework.sources import io
from latticework.streaming import feed


@pytest.fixture(scope="module")
def graph(spark):
    g = PropertyGraph(spark)
    g.add_nodes("Person", spark.createDataFrame([(k, n, c) for k, (n, c) in enumerate([("A", "x"), ("B", "x"), ("C", None), ("D", "y"), ("E", "y")])], "id long, name string, city string"))
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (2, 3), (3, 3)]
    g.add_edges("KNOWS", "Person", "Person", spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "rid long, src long, dst long"))
    return g


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_patterns(graph):
    a = graph.match("a", "Person")
    two = a.hop("a", "KNOWS", "b", "Person").hop("b", "KNOWS", "c", "Person")
    # the loop may not be walked twice, parallel edges may follow one another's end
    assert pairs(two.frame, "a_id", "b_id", "c_id") == [(0, 1, 2), (1, 2, 0), (1, 2, 3), (1, 2, 3), (2, 0, 1), (2, 3, 3), (2, 3, 3)]
    assert pairs(a.hop("a", "KNOWS", "b", "Person", direction="both").frame.where("a_id = 3"), "b_id") == [(2,), (2,), (3,)]
    cycle = a.hop("a", "KNOWS", "b", "Person").hop("b", "KNOWS", "c", "Person").hop("c", "KNOWS", "a", "Person")
    assert pairs(cycle.frame, "a_id") == [(0,), (1,), (2,)]
    assert pairs(a.optional("a", "KNOWS", "b", "Person", where="city = 'x'").frame.where("b_id is null"), "a_id") == [(1,), (3,), (4,)]
    assert pairs(a.exists("a", "KNOWS", "Person", negate=True).frame, "a_id") == [(4,)]
    assert pairs(a.count("a", "KNOWS", "Person", "n").frame, "a_id", "n") == [(0, 1), (1, 1), (2, 3), (3, 1), (4, 0)]
    trails = a.where("a_id = 0").paths("a", "KNOWS", "p", 0, 10).frame
    assert pairs(trails, "p_id", "p_hops") == [(0, 0), (0, 3), (1, 1), (2, 2), (3, 3), (3, 3), (3, 4), (3, 4)]
    with pytest.raises(KeyError):
        graph.match("a", "Nobody")


def test_algorithms(graph, spark):
    nodes, edges = graph.nodes["Person"], graph.all_edges("KNOWS")
    rank = {r["id"]: r["score"] for r in A.pagerank(nodes, edges, iterations=60).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank[3] == max(rank.values())
    assert pairs(A.components(nodes, edges), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
    assert pairs(A.k_core(nodes, edges), "id", "coreness") == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 0)]
    assert A.triangles(edges).collect() == [(0, 1, 2)]
    assert pairs(A.hops_from(nodes.where("id = 1"), edges), "id", "hops") == [(0, 2), (1, 0), (2, 1), (3, 2)]
    two = spark.createDataFrame([(0, 3), (3, 0), (4, 4)], "a long, b long")
    assert pairs(A.shortest_path_lengths(two, edges), "a", "b", "hops") == [(0, 3, 3)]
    assert {r["community"] for r in A.label_propagation(nodes, edges).collect() if r["id"] == 4} == {4}
    done = spark.createDataFrame([(3,)], "id long")
    assert pairs(A.ready_set(nodes, edges.where("rid in (0, 3)"), done), "id", "dependency_count") == [(1, 0), (2, 1), (4, 0)]


def test_rules_and_selection(graph):
    nodes, edges = graph.nodes["Person"], graph.all_edges("KNOWS")
    assert pairs(R.self_loop(edges), "id") == [(3,)] and pairs(R.parallel_edges(edges), "a", "b", "n") == [(2, 3, 2)]
    assert pairs(R.orphan_node(nodes, edges), "id") == [(4,)] and pairs(R.null_property(nodes, "city"), "id") == [(2,)]
    assert pairs(R.duplicate_property(nodes, "city"), "id") == [(0,), (1,), (3,), (4,)]
    s = Selection.of(graph, "Person")
    assert pairs(s.where(city={"!=": "x"}).frame, "id") == [(3,), (4,)]
    assert pairs(s.where(city={"is_null": True}).union(s.where(name=["A", "B"])).frame, "id") == [(0,), (1,), (2,)]
    assert pairs(s.where(name="C").traverse("KNOWS", "Person").frame, "id") == [(0,), (3,)]
    assert pairs(s.top(1, "name", per="city").frame, "id") == [(1,), (2,), (4,)]
    assert pairs(s.having_edges("KNOWS", "Person", negate=True).frame, "id") == [(4,)]


def test_merge_modes(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 2, None)], "id long, n int, s string")
    new = spark.createDataFrame([(2, 5, None), (3, 7, "c")], "id long, n int, s string")
    want = {"update": (5, None), "preserve": (2, None), "sum": (7, None), "replace": (5, None), "skip": (2, None)}
    for mode, (n, s) in want.items():
        got = {r["id"]: (r["n"], r["s"]) for r in io.merge_nodes(old, new, mode).collect()}
        assert got == {1: (1, "a"), 2: (n, s), 3: (7, "c")}


def test_files(graph, spark, tmp_path):
    io.save(graph, f"{tmp_path}/g")
    back = io.load(spark, f"{tmp_path}/g")
    assert back.all_edges("KNOWS").count() == 6 and back.nodes["Person"].count() == 5
    assert io.graphml_lines(graph).count() == 11 and io.d3_lines(graph).count() == 11
    (tmp_path / "t.nt").write_text('<http://a> <http://p> "x \\"y\\""@en .\n# note\n<http://a> <http://q> <http://b> .\n_:n <http://p> "1"^^<http://int> .\n<http://a> <http://p> "z"@de .\n')
    t = io.read_triples(spark, f"{tmp_path}/t.nt", ["en"])
    assert t.count() == 3 and t.where("object = 'http://b'").count() == 1
    (tmp_path / "people.csv").write_text("pid,name,boss,age\n1,ann,,40\n2,bob,1,30\n3,cat,1,15\n")
    g = io.from_csv_spec(spark, str(tmp_path), {"nodes": {"P": {"file": "people.csv", "types": {"pid": "long", "age": "int", "boss": "long"}, "id": "pid", "filter": "age > 20", "derive": {"up": "upper(name)"}, "parents": {"boss": ["REPORTS_TO", "P"]}}}})
    assert pairs(g.nodes["P"], "up") == [("ANN",), ("BOB",)] and pairs(g.all_edges("REPORTS_TO"), "src", "dst") == [(2, 1)]
    r = io.from_records(spark, {"nodes": {"X": [{"id": 1}]}, "edges": [{"type": "T", "source": "X", "target": "X", "rows": [{"src": 1, "dst": 9}]}]})
    assert pairs(r.nodes["X"], "id") == [(1,), (9,)]


def test_change_feed_as_table_and_stream(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    two = spark.createDataFrame([(2, "B"), (3, "c")], "id long, s string")
    path = f"{tmp_path}/feed"
    feed.append(path, feed.changes(one.limit(0), one, 1))
    feed.append(path, feed.changes(one, two, 2))
    assert pairs(feed.query(spark, path, 1), "operation", "id") == [("create", 3), ("delete", 1), ("update", 2)]
    assert feed.query(spark, path, operations=["create"]).count() == 3
    q = feed.counts_by_operation(feed.stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("ops").start()
    q.processAllAvailable()
    q.stop()
    assert pairs(spark.table("ops"), "operation", "n") == [("create", 3), ("delete", 1), ("update", 1)]


def test_scalars(spark):
    row = spark.range(1).select(
        F.round(S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("m"),
        S.point_in_polygon(F.lit(0.5), F.lit(0.5), [(0, 0), (0, 1), (1, 1), (1, 0)]).alias("inside"),
        S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        S.add_duration(F.lit("2024-01-31").cast("date"), S.duration(months=1, days=1)).cast("date").cast("string").alias("due"),
        S.point_in_polygon(F.lit(10.0), F.lit(20.001), S.circle(10, 20, 1000)).alias("near"),
    ).first()
    assert (row.m, row.inside, row.zero, row.due, row.near) == (111195.0, True, None, "2024-03-01", True)
