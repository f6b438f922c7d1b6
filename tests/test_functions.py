import pytest
from pyspark.sql import functions as F

from latticework.functions import dates as D
from latticework.functions import lists as L
from latticework.functions import numbers as N
from latticework.functions import scalars as S
from latticework.functions import text as T
from latticework.functions import timeseries as TS
from latticework.operators import algorithms as A
from latticework.operators import paths as P
from latticework.plans.graph import PropertyGraph
from latticework.sources import io


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_text(spark):
    s = lambda x: F.lit(x).cast("string")
    assert values(spark, T.trim(s("   a b　")), T.split(s("a.b..c"), "."), T.split(s(""), ","), T.split(s("é€"), ""), T.left(s("ab"), 5), T.right(s("ab"), 1), T.right(s("ab"), -1)) == ["a b", ["a", "b", "", "c"], [""], ["é", "€"], "ab", "b", ""]
    assert values(spark, T.normalize(s("  Héllo,  W-orld! ")), T.jaccard(s("a b b"), s("b c")), T.jaccard(s(""), s(" ")), T.ngrams(s("abcd"), 3), T.ngrams(s("ab"), 3)) == ["héllo world", 1 / 3, 1.0, ["abc", "bcd"], []]
    assert values(spark, T.trim(s(None)), T.split(s(None), ","), T.ngrams(s(None), 2), T.contains_any(s(None), ["a"]), T.contains_any(s("x"), []), T.starts_with_any(s("xy"), ["y", "x"])) == [None, None, None, None, False, True]


def test_numbers_give_null_not_nan(spark):
    s = lambda x: F.lit(x).cast("string")
    x = lambda v: F.lit(v).cast("double")
    assert values(spark, *[N.to_integer(s(v)) for v in ("12", "-7", " 3 ", "3.0", "", "9999999999999999999", None)]) == [12, -7, None, None, None, None, None]
    assert values(spark, *[N.to_float(s(v)) for v in ("1e3", ".5", "5.", "NaN", "Infinity", "1e999", "x")]) == [1000.0, 0.5, 5.0, None, None, None, None]
    assert values(spark, N.round_half_away(x(2.5)), N.round_half_away(x(-2.5)), N.sqrt(x(-1)), N.asin(x(2)), N.acos(x(-1.5)), N.log10(x(0)), N.power(x(10), x(400)), N.cot(x(0))) == [3.0, -3.0, None, None, None, None, None, None]


def test_dates(spark):
    d = lambda v: F.lit(v).cast("date")
    got = values(spark, *[D.date_of(F.lit(v)).cast("string") for v in ("2020", "2020-3", "2020-02-29", "2020-02-30", "20-1-1", "x")])
    assert got == ["2020-01-01", "2020-03-01", "2020-02-29", None, None, None]
    assert values(spark, D.add_years(d("2020-02-29"), 1).cast("string"), D.truncate(d("2024-05-16"), "week").cast("string"), D.datetime_of(F.lit("2020-01-02T03:04:05")).cast("string"), D.datetime_of(F.lit("no"))) == ["2021-02-28", "2024-05-13", "2020-01-02 03:04:05", None]
    r = values(spark, D.duration_between(F.lit("2020-01-01 00:00:10").cast("timestamp"), F.lit("2020-01-03 00:00:05").cast("timestamp")))[0]
    assert (r.months, r.days, r.seconds) == (0, 1, 86395)


def test_lists(spark):
    a = lambda *v: F.array(*[F.lit(x).cast("int") for x in v]) if v else F.array().cast("array<int>")
    big = lambda c: c > 2
    assert values(spark, L.head(a()), L.last(a()), L.last(a(1, None)), L.at(a(1, 2), -3), L.at(a(1, 2), 5), L.cut(a(1, 2, 3), 1, 9)) == [None, None, None, None, None, [2, 3]]
    assert values(spark, L.any_of(a(1, None), big), L.any_of(a(3, None), big), L.all_of(a(3, None), big), L.all_of(a(), big), L.none_of(a(1, None), big), L.single_of(a(3, None), big), L.single_of(a(3, 4, None), big), L.single_of(a(1, 3), big)) == [None, True, None, True, None, None, False, True]
    n = lambda x: F.lit(x).cast("long")
    assert values(spark, L.numbers(n(1), n(5), 2), L.numbers(n(3), n(1)), L.numbers(n(3), n(1), -1), L.numbers(n(None), n(1))) == [[1, 3, 5], [], [3, 2, 1], None]


def test_geometry(spark):
    x = lambda v: F.lit(float(v))
    # published lengths: Vincenty's test line, a degree of the equator; the quarter meridian
    line = S.distance(x(-37.95103341666667), x(144.42486788888888), x(-37.65282113888889), x(143.92649552777777))
    got = values(spark, line, S.distance(x(0), x(0), x(0), x(1)), S.distance(x(0), x(0), x(90), x(0)), S.distance(x(5), x(5), x(5), x(5)), S.distance(x(0), x(0), x(0.5), x(179.7)))
    assert got[0] == pytest.approx(54972.271, abs=0.002) and got[1] == pytest.approx(111319.491, abs=0.001) and got[2] == pytest.approx(10001965.729, abs=0.01) and got[3:] == [0.0, None]
    wkt = F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")
    rings = S.polygon(wkt)
    assert values(spark, S.rings_contain(rings, x(3), x(3)), S.rings_contain(rings, x(1.5), x(1.5)), S.rings_contain(rings, x(5), x(1)), S.rings_contain(S.polygon(F.lit("POINT (1 2)")), x(1), x(1))) == [True, False, False, None]
    centre, around = values(spark, S.ring_centroid(rings), S.ring_perimeter(rings))
    assert tuple(centre) == (2.0, 2.0) and around == pytest.approx(4 * 444_000, rel=0.01)


def test_series_keys(spark):
    assert [tuple(map(str, TS.bounds(k))) for k in ("2020", "2020-02", "2020-12", "2020-02-03")] == [("2020-01-01", "2020-12-31"), ("2020-02-01", "2020-02-29"), ("2020-12-01", "2020-12-31"), ("2020-02-03", "2020-02-03")]
    rows = [(1, "2020-01-01 00:00:00", "a", 1.0), (1, "2020-02-29 23:00:00", "a", 5.0), (1, "2021-01-01 00:00:00", "a", None), (2, "2021-05-01 00:00:00", "a", 7.0)]
    s = spark.createDataFrame(rows, "id long, at string, channel string, value double").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.id: (r["sum"], r["mean"], r["count"], r["first"], r["last"]) for r in TS.summary(s, "2020").collect()}
    assert got == {1: (6.0, 3.0, 2, 1.0, 5.0), 2: (0.0, None, 0, None, None)}
    assert [(r.id, r.delta) for r in TS.delta(s, "2020-01", "2020-02").collect()] == [(1, 4.0)]
    assert {r.id: len(r.points) for r in TS.points(s, "2020-02", "2021").collect()} == {1: 2, 2: 1}
    assert TS.between(s).count() == 4 and [r.value for r in TS.at(s, "2021-05-01").collect()] == [7.0]


def chain(spark):
    g = PropertyGraph(spark).add_nodes("N", spark.createDataFrame([(k, f"n{k}") for k in range(5)], "id long, name string"))
    return g.add_edges("E", "N", "N", spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "src long, dst long"))


def test_parallel_edges_are_two(spark):
    g = chain(spark)
    back = g.match("a", "N", "id = 0").hop("a", "E", "b", "N").hop("b", "E", "c", "N", direction="in")
    assert back.frame.where("c_id = 0").count() == 2  # there by one edge, back by the other
    again = g.match("a", "N", "id = 0").hop("a", "E", "b", "N").clause().hop("b", "E", "c", "N", direction="in")
    assert again.frame.where("c_id = 0").count() == 4
    assert {r.p_id for r in g.match("a", "N", "id = 0").paths("a", "E", "p", 1, 3, "both").frame.collect()} == {0, 1, 2}


def test_optional_pattern_is_all_or_nothing(spark):
    g = chain(spark)
    rows = g.match("a", "N").optional_pattern("a", lambda r: r.hop("a", "E", "b", "N").hop("b", "E", "c", "N"))
    got = sorted((r.a_id, r.b_id, r.c_id) for r in rows.frame.where("a_id in (0, 1)").collect())
    assert got == [(0, 1, 2), (0, 1, 2), (1, None, None)]


def test_writes(spark):
    g = chain(spark)
    with pytest.raises(ValueError):
        g.delete_nodes("N", spark.createDataFrame([(2,)], "id long"))
    g.delete_nodes("N", spark.createDataFrame([(4,)], "id long"))
    assert g.nodes["N"].count() == 4 and g.all_edges("E").count() == 3
    g.set_properties("N", spark.createDataFrame([(1, None, 9)], "id long, name string, age int"))
    assert {r.id: (r.name, r.age) for r in g.nodes["N"].where("id < 2").collect()} == {0: ("n0", None), 1: (None, 9)}
    g.set_properties("N", spark.createDataFrame([(0, 3)], "id long, age int"), replace=True)
    assert {r.id: (r.name, r.age) for r in g.nodes["N"].where("id in (0, 2)").collect()} == {0: (None, 3), 2: ("n2", None)}
    for mode, want in (("update", (5, 7)), ("skip", (1, 7)), ("replace", (5, None)), ("sum", (6, 7))):
        h = PropertyGraph(spark).add_edges("E", "N", "N", spark.createDataFrame([(1, 2, 1, 7), (3, 4, 1, 1)], "src long, dst long, w long, x long"))
        h.merge_edges("E", "N", "N", spark.createDataFrame([(1, 2, 5, None), (8, 9, 2, 2)], "src long, dst long, w long, x long"), mode)
        got = {(r.src, r.dst): (r.w, r.x) for r in h.all_edges("E").collect()}
        assert got == {(1, 2): want, (3, 4): (1, 1), (8, 9): (2, 2)}


def test_core_paths_and_csv(spark, tmp_path):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 3), (1, 3)]
    nodes, frame = spark.range(6), spark.createDataFrame(edges, "src long, dst long")
    assert {r.id: r.coreness for r in A.k_core(nodes, frame).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 0}
    assert P.diameter(nodes, frame) == 2
    pairs = spark.createDataFrame([(0, 4), (4, 0), (1, 1)], "a long, b long")
    assert {(r.a, r.b): (r.hops, r.path) for r in P.shortest_paths(pairs, frame).collect()} == {(0, 4): (2, [0, 3, 4]), (1, 1): (0, [1])}
    assert abs(sum(r.score for r in A.pagerank(nodes, frame, tolerance=1e-9, iterations=60).collect()) - 1) < 1e-6
    (tmp_path / "x.csv").write_text("a;b\n01;\n2;x\n")
    assert [tuple(r) for r in io.load_csv(spark, f"{tmp_path}/x.csv", ";").collect()] == [("01", None), ("2", "x")]
