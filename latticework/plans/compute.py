"""Computed elements of a declarative load: chains, calendars, summaries, derived columns and filtered copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.plans.graph import PropertyGraph


def chain(graph: PropertyGraph, label: str, kind: str, per: str, by: list[str]) -> PropertyGraph:
    """An edge from each row to the next of its group."""
    after = F.lead("id").over(Window.partitionBy(per).orderBy(*by, "id"))
    frame = graph.nodes[label].select(F.col("id").alias("src"), after.alias("dst")).where("dst is not null")
    return graph.add_edges(kind, label, label, frame)


def calendar(graph: PropertyGraph, label: str, column: str, link: str = "ON_DATE") -> PropertyGraph:
    """``Date``, ``Month`` and ``Year`` nodes over the range of a column, their hierarchy, and links from its rows."""
    day = F.to_date(column)
    span = graph.nodes[label].agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    dates = span.select(F.explode(F.sequence("a", "b")).alias("id"))
    dates = dates.select("id", F.year("id").alias("year"), F.quarter("id").alias("quarter"), F.month("id").alias("month"), F.date_format("id", "yyyy-MM").alias("month_id"))
    graph.add_nodes("Date", dates)
    graph.add_nodes("Month", dates.select(F.col("month_id").alias("id"), "year", "month").distinct()).add_nodes("Year", dates.select(F.col("year").alias("id")).distinct())
    graph.add_edges("NEXT_DAY", "Date", "Date", dates.select(F.col("id").alias("src"), F.date_add("id", 1).alias("dst")).join(dates.select(F.col("id").alias("dst")), "dst", "left_semi"))
    graph.add_edges("IN_MONTH", "Date", "Month", dates.select(F.col("id").alias("src"), F.col("month_id").alias("dst")))
    graph.add_edges("IN_YEAR", "Month", "Year", dates.select(F.col("month_id").alias("src"), F.col("year").alias("dst")).distinct())
    return graph.add_edges(link, label, "Date", graph.nodes[label].select(F.col("id").alias("src"), day.alias("dst")).where("dst is not null"))


def aggregate(graph: PropertyGraph, label: str, into: str, keys: list[str], measures: dict[str, str], link: str) -> PropertyGraph:
    """A summary node per group, with measures in SQL, and an edge from each member."""
    named = graph.nodes[label].withColumn("_group", F.to_json(F.struct(*keys)))
    summary = named.groupBy("_group", *keys).agg(*[F.expr(sql).alias(name) for name, sql in measures.items()])
    graph.add_nodes(into, summary, "_group")
    return graph.add_edges(link, label, into, named.select(F.col("id").alias("src"), F.col("_group").alias("dst")))


def derive(graph: PropertyGraph, label: str, columns: dict[str, str]) -> PropertyGraph:
    frame = graph.nodes[label]
    for name, sql in columns.items():
        frame = frame.withColumn(name, F.expr(sql))
    graph.nodes[label] = frame
    return graph


def keep(graph: PropertyGraph, label: str, where: str, into: str | None = None) -> PropertyGraph:
    """Filters in place, or into another label."""
    graph.nodes[into or label] = graph.nodes[label].where(where)
    return graph


def property_stats(nodes: DataFrame, name: str) -> DataFrame:
    """``(value_count, null_count, distinct_count, is_unique)``."""
    c = F.col(name)
    return nodes.agg(F.count(c).alias("value_count"), F.count_if(c.isNull()).alias("null_count"), F.countDistinct(c).alias("distinct_count")).withColumn("is_unique", F.col("value_count") == F.col("distinct_count"))
