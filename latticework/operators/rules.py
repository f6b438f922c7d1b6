"""Structural data-quality rules: each returns the elements that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_node(nodes: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    out = nodes
    for end in ends:
        out = out.join(edges.select(F.col(end).alias("id")), "id", "left_anti")
    return out


def missing_required_edge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return orphan_node(nodes, edges, "out")


def missing_inbound_edge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return orphan_node(nodes, edges, "in")


def self_loop(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select(F.col("src").alias("id")).distinct()


def cycle_2step(edges: DataFrame) -> DataFrame:
    """``(a, b)`` with edges both ways, a < b."""
    back = edges.selectExpr("dst as src", "src as dst")
    return edges.where("src < dst").select("src", "dst").join(back, ["src", "dst"], "left_semi").selectExpr("src as a", "dst as b").distinct()


def duplicate_property(nodes: DataFrame, name: str) -> DataFrame:
    """Every node whose value repeats."""
    copies = nodes.groupBy(name).agg(F.count("*").alias("copies")).where("copies > 1")
    return nodes.join(copies, name).select(*nodes.columns, "copies")


def null_property(nodes: DataFrame, name: str) -> DataFrame:
    empty = (F.col(name) == "") if dict(nodes.dtypes)[name] == "string" else F.lit(False)
    return nodes.where(F.col(name).isNull() | empty)


def inverse_violation(edges: DataFrame, inverse: DataFrame) -> DataFrame:
    """``(a, b)`` of edges whose reverse is not among ``inverse``."""
    return edges.selectExpr("src as a", "dst as b").join(inverse.selectExpr("dst as a", "src as b"), ["a", "b"], "left_anti")


def transitivity_violation(edges: DataFrame) -> DataFrame:
    """``(a, b, c)``: a to b and b to c, but not a to c."""
    one = edges.select("src", "dst").distinct()
    two = one.selectExpr("src as a", "dst as b").join(one.selectExpr("src as b", "dst as c"), "b").where("a <> c and b <> c and a <> b")
    return two.join(one.selectExpr("src as a", "dst as c"), ["a", "c"], "left_anti").select("a", "b", "c")


def cardinality_violation(nodes: DataFrame, edges: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """``(id, n)`` of nodes with too few or too many outgoing edges."""
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    counted = nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    wrong = F.col("n") < least
    return counted.where(wrong if most is None else wrong | (F.col("n") > most))


def parallel_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").alias("n")).where("n > 1")


def endpoint_violation(edges: DataFrame, nodes: DataFrame, end: str = "src") -> DataFrame:
    """Edges whose source (or target) is not among the nodes of the label that is expected there."""
    return edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
