from latticework.operators.components import connected_components
from latticework.storage import Scratch


def test_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)] + [(3, 4)] * 3
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(df, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, **{200 + i: 100 for i in range(30)}}


def test_empty_and_strings(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string"), Scratch(spark)).count() == 0
    df = spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")
    assert {tuple(r) for r in connected_components(df, Scratch(spark)).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
