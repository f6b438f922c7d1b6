"""Chainable selections: levels of nodes, filtered, ranked, traversed and combined; each step is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.plans.graph import PropertyGraph


class Selection:
    def __init__(self, graph: PropertyGraph, label: str, frame: DataFrame):
        self.graph, self.label, self.frame = graph, label, frame

    @staticmethod
    def of(graph: PropertyGraph, label: str) -> "Selection":
        return Selection(graph, label, graph.nodes[label])

    def _new(self, frame: DataFrame, label: str | None = None) -> "Selection":
        return Selection(self.graph, label or self.label, frame)

    @staticmethod
    def _condition(name: str, test) -> Column:
        """A value, a list, or a dict of operators. Null passes ``is_null`` only."""
        c = F.col(name)
        if isinstance(test, dict):
            ops = {
                "=": lambda v: c == v, "!=": lambda v: c != v, ">": lambda v: c > v, ">=": lambda v: c >= v, "<": lambda v: c < v,
                "<=": lambda v: c <= v, "in": lambda v: c.isin(list(v)), "not_in": lambda v: ~c.isin(list(v)), "contains": c.contains,
                "starts_with": c.startswith, "ends_with": c.endswith, "regex": lambda v: c.rlike(f"^(?:{v})$"), "between": lambda v: c.between(*v),
                "is_null": lambda v: c.isNull() if v else c.isNotNull(),
            }
            out = F.lit(True)
            for op, value in test.items():
                out = out & F.coalesce(ops[op](value), F.lit(False))
            return out
        return F.coalesce(c.isin(list(test)) if isinstance(test, (list, tuple, set)) else c == test, F.lit(False))

    def where(self, **tests) -> "Selection":
        out = self.frame
        for name, test in tests.items():
            out = out.where(self._condition(name, test))
        return self._new(out)

    def where_any(self, *groups: dict) -> "Selection":
        whole = F.lit(False)
        for group in groups:
            part = F.lit(True)
            for name, test in group.items():
                part = part & self._condition(name, test)
            whole = whole | part
        return self._new(self.frame.where(whole))

    def traverse(self, kind: str, label: str, direction: str = "out") -> "Selection":
        """The distinct nodes at the other end."""
        edges = self.graph.all_edges(kind, **({"source": self.label, "target": label} if direction == "out" else {"source": label, "target": self.label}))
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        ids = edges.join(self.frame.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id"))
        return self._new(self.graph.nodes[label].join(ids, "id", "left_semi"), label)

    def top(self, k: int, by: str, descending: bool = True, per: str | None = None) -> "Selection":
        order = [F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), F.col("id")]
        if per is None:
            return self._new(self.frame.orderBy(*order).limit(k))
        ranked = self.frame.withColumn("_rank", F.row_number().over(Window.partitionBy(per).orderBy(*order)))
        return self._new(ranked.where(F.col("_rank") <= k).drop("_rank"))

    def calculate(self, name: str, expression: str) -> "Selection":
        return self._new(self.frame.withColumn(name, F.expr(expression)))

    def statistics(self, name: str, per: str | None = None) -> DataFrame:
        agg = [F.count(name).alias("n"), F.sum(name).alias("sum"), F.avg(name).alias("mean"), F.min(name).alias("min"), F.max(name).alias("max"), F.stddev_samp(name).alias("std")]
        return (self.frame.groupBy(per) if per else self.frame.groupBy()).agg(*agg)

    def union(self, other: "Selection") -> "Selection":
        return self._new(self.frame.unionByName(other.frame, allowMissingColumns=True).dropDuplicates(["id"]))

    def intersection(self, other: "Selection") -> "Selection":
        return self._new(self.frame.join(other.frame.select("id"), "id", "left_semi"))

    def difference(self, other: "Selection") -> "Selection":
        return self._new(self.frame.join(other.frame.select("id"), "id", "left_anti"))

    def symmetric_difference(self, other: "Selection") -> "Selection":
        return self.difference(other).union(other.difference(self))

    def having_edges(self, kind: str, label: str, direction: str = "out", negate: bool = False) -> "Selection":
        edges = self.graph.all_edges(kind, **({"source": self.label, "target": label} if direction == "out" else {"source": label, "target": self.label}))
        end = "src" if direction == "out" else "dst"
        return self._new(self.frame.join(edges.select(F.col(end).alias("id")), "id", "left_anti" if negate else "left_semi"))

    def levels(self, kind: str, label: str, direction: str = "out", where=None, top: tuple[str, int] | None = None) -> DataFrame:
        """``(parent, id, properties)``: the distinct nodes at the other end, for each node of the selection; ``top`` keeps
        the so many largest of a property for each parent."""
        edges = self.graph.all_edges(kind, **({"source": self.label, "target": label} if direction == "out" else {"source": label, "target": self.label}))
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        pairs = edges.select(F.col(a).alias("parent"), F.col(b).alias("id")).distinct().join(self.frame.select(F.col("id").alias("parent")), "parent", "left_semi")
        nodes = self.graph.nodes[label] if where is None else self.graph.nodes[label].where(where)
        out = pairs.join(nodes, "id")
        if top:
            name, k = top
            ranked = out.withColumn("_rank", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc_nulls_last(name), "id")))
            out = ranked.where(F.col("_rank") <= k).drop("_rank")
        return out

    def add_properties(self, kind: str, label: str, measures: dict[str, str], direction: str = "out") -> "Selection":
        """Aggregates over the neighbours as properties, in SQL over their columns; null (counts: 0) without any."""
        found = self.levels(kind, label, direction).groupBy("parent").agg(*[F.expr(sql).alias(name) for name, sql in measures.items()])
        joined = self.frame.join(found, F.col("id") == F.col("parent"), "left").drop("parent")
        for name, sql in measures.items():
            if sql.lower().startswith("count"):
                joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))
        return self._new(joined)

    def count(self, per: str | None = None) -> DataFrame:
        return (self.frame.groupBy(per) if per else self.frame.groupBy()).agg(F.count("*").alias("n"))

    def unique_values(self, name: str) -> DataFrame:
        return self.frame.where(F.col(name).isNotNull()).select(name).distinct()

    def valid(self, start: str, end: str, when) -> "Selection":
        """Nodes whose validity holds the time; open bounds are null."""
        return self._new(self.frame.where((F.col(start).isNull() | (F.col(start) <= when)) & (F.col(end).isNull() | (F.col(end) >= when))))
