"""Labelled property graphs over DataFrames, and patterns on them as join plans.

A node table has an ``id``; an edge table has ``src`` and ``dst`` (ids of its two labels) and ``rid``. A pattern names
its elements, and each property appears as ``<name>_<property>``. Everything stays lazy: Catalyst prunes the
properties that nobody reads, pushes predicates into the scans and picks the joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class EdgeTable:
    source: str
    target: str
    frame: DataFrame


@dataclass
class PropertyGraph:
    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, list[EdgeTable]] = field(default_factory=dict)

    def add_nodes(self, label: str, frame: DataFrame, id: str = "id") -> "PropertyGraph":
        frame = frame if id == "id" else frame.withColumnRenamed(id, "id")
        self.nodes[label] = frame if label not in self.nodes else self.nodes[label].unionByName(frame, allowMissingColumns=True)
        return self

    def add_edges(self, kind: str, source: str, target: str, frame: DataFrame, src: str = "src", dst: str = "dst", stubs: bool = False) -> "PropertyGraph":
        """Registers edges; with ``stubs`` endpoints without a node get one that has only its id.

        Edges without ``rid`` get one: a hash of the row and its number among equal rows, so that parallel edges differ.
        """
        frame = frame.withColumnsRenamed({src: "src", dst: "dst"})
        if "rid" not in frame.columns:
            columns = frame.columns
            frame = frame.withColumn("_copy", F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(1))))
            frame = frame.withColumn("rid", F.xxhash64(F.lit(f"{kind}:{source}:{target}"), *columns, "_copy")).drop("_copy")
        self.edges.setdefault(kind, []).append(EdgeTable(source, target, frame))
        if stubs:
            for label, end in ((source, "src"), (target, "dst")):
                ids = frame.select(F.col(end).alias("id")).distinct()
                known = self.nodes.get(label)
                new = ids if known is None else ids.join(known.select("id"), "id", "left_anti")
                self.add_nodes(label, new)
        return self

    def edge_tables(self, kinds: str | list[str], source: str | None = None, target: str | None = None) -> list[EdgeTable]:
        names = [kinds] if isinstance(kinds, str) else kinds
        return [e for k in names for e in self.edges.get(k, []) if source in (None, e.source) and target in (None, e.target)]

    def all_edges(self, kinds: str | list[str], **ends) -> DataFrame:
        """``(src, dst, rid, properties)`` of all tables of the kinds."""
        tables = [e.frame for e in self.edge_tables(kinds, **ends)]
        if not tables:
            raise KeyError(f"no edges of {kinds}; there are {sorted(self.edges)}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

    def all_nodes(self, *properties: str) -> DataFrame:
        """``(label, id, properties)`` of every label; ids as text, since labels may have ids of other types."""
        parts = []
        for label, frame in self.nodes.items():
            own = [F.col(p).cast("string").alias(p) if p in frame.columns else F.lit(None).cast("string").alias(p) for p in properties]
            parts.append(frame.select(F.lit(label).alias("label"), F.col("id").cast("string").alias("id"), *own))
        return reduce(DataFrame.unionAll, parts)

    def search(self, text: str, labels: list[str] | None = None) -> DataFrame:
        """``(label, id, property)`` of string properties that hold the text, whatever its case, in all labels."""
        parts = []
        for label in labels or self.nodes:
            frame = self.nodes[label]
            names = [c for c, t in frame.dtypes if t == "string"]
            hits = F.array_compact(F.array(*[F.when(F.lower(c).contains(text.lower()), F.lit(c)) for c in names])) if names else F.array().cast("array<string>")
            parts.append(frame.select(F.lit(label).alias("label"), F.col("id").cast("string").alias("id"), F.explode(hits).alias("property")))
        return reduce(DataFrame.unionAll, parts)

    # --- writes: each returns the graph with new tables; frames that were read before stay as they were

    def create_nodes(self, label: str, frame: DataFrame) -> "PropertyGraph":
        return self.add_nodes(label, frame)

    def set_properties(self, label: str, changes: DataFrame, replace: bool = False) -> "PropertyGraph":
        """Values of ``changes(id, ...)`` win, nulls included; other properties stay, or with ``replace`` become null."""
        old, new = self.nodes[label].alias("o"), changes.withColumn("_hit", F.lit(True)).alias("n")
        columns = []
        for c in dict.fromkeys([*self.nodes[label].columns, *changes.columns]):
            if c == "id":
                columns.append(F.col("o.id"))
            elif c not in changes.columns:
                columns.append((F.when(F.col("n._hit").isNull(), F.col(f"o.{c}")) if replace else F.col(f"o.{c}")).alias(c))
            else:
                before = F.col(f"o.{c}") if c in self.nodes[label].columns else F.lit(None)
                columns.append(F.when(F.col("n._hit"), F.col(f"n.{c}")).otherwise(before).alias(c))
        self.nodes[label] = old.join(new, F.col("o.id") == F.col("n.id"), "left").select(*columns)
        return self

    def remove_property(self, label: str, name: str, where: Column | str = "true") -> "PropertyGraph":
        hit = F.expr(where) if isinstance(where, str) else where
        kept = F.when(~F.coalesce(hit, F.lit(False)), F.col(name))
        self.nodes[label] = self.nodes[label].withColumn(name, kept)
        return self

    def delete_nodes(self, label: str, gone: DataFrame, detach: bool = False) -> "PropertyGraph":
        """Without ``gone(id)``. Their edges go with ``detach``; otherwise any edge left to them is an error."""
        ids = gone.select("id").distinct()
        for kind, tables in self.edges.items():
            for e in tables:
                for end, of in (("src", e.source), ("dst", e.target)):
                    if of != label:
                        continue
                    side = ids.withColumnRenamed("id", end)
                    if not detach and not e.frame.join(side, end, "left_semi").isEmpty():
                        raise ValueError(f"{label} nodes still have {kind} edges; detach them too")
                    e.frame = e.frame.join(side, end, "left_anti").select(*e.frame.columns)
        self.nodes[label] = self.nodes[label].join(ids, "id", "left_anti")
        return self

    def delete_edges(self, kind: str, where: Column | str) -> "PropertyGraph":
        hit = F.expr(where) if isinstance(where, str) else where
        for e in self.edges[kind]:
            e.frame = e.frame.where(~F.coalesce(hit, F.lit(False)))
        return self

    def replace_edges(self, kind: str, source: str, target: str, frame: DataFrame) -> "PropertyGraph":
        """The sources in ``frame`` lose their edges of the kind to the target label and get those of ``frame``."""
        for e in self.edge_tables(kind, source, target):
            e.frame = e.frame.join(frame.select("src").distinct(), "src", "left_anti").select(*e.frame.columns)
        return self.add_edges(kind, source, target, frame)

    def merge_edges(self, kind: str, source: str, target: str, frame: DataFrame, mode: str = "update") -> "PropertyGraph":
        """One edge for each pair of ends: new ones are added; of known ones update: new values win where not null, skip: the old
        stay, replace: the new come whole, sum: numbers add up."""
        old = self.edge_tables(kind, source, target)
        known = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [e.frame for e in old]).drop("rid") if old else frame.limit(0)
        a, b = known.withColumn("_old", F.lit(True)).alias("a"), frame.withColumn("_new", F.lit(True)).alias("b")
        both = a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst")), "full")
        types, columns = {**dict(frame.dtypes), **dict(known.dtypes)}, []
        for c, t in types.items():
            x = F.col(f"a.{c}") if c in known.columns else F.lit(None).cast(t)
            y = F.col(f"b.{c}") if c in frame.columns else F.lit(None).cast(t)
            if mode == "skip":
                value = F.when(F.col("_old"), x).otherwise(y)
            elif mode == "replace":
                value = F.when(F.col("_new"), y).otherwise(x)
            elif mode == "sum" and t in ("int", "bigint", "double", "float") and c not in ("src", "dst"):
                value = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)
            else:
                value = F.coalesce(y, x)
            columns.append((F.coalesce(x, y) if c in ("src", "dst") else value).alias(c))
        self.edges[kind] = [e for e in self.edges.get(kind, []) if e not in old]
        return self.add_edges(kind, source, target, both.select(*columns))

    def property_keys(self) -> DataFrame:
        """``(element, name, property, type, observations)``: how many elements have each property."""
        frames = [("node", label, f) for label, f in self.nodes.items()]
        frames += [("edge", k, e.frame.drop("rid")) for k, ts in self.edges.items() for e in ts]
        parts = []
        for element, name, f in frames:
            own = [(c, t) for c, t in f.dtypes if c not in ("id", "src", "dst")]
            if own:
                counts = f.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c, _ in own])
                rows = F.array(*[F.struct(F.lit(c).alias("property"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("observations")) for c, t in own])
                parts.append(counts.select(F.explode(rows).alias("r")).select(F.lit(element).alias("element"), F.lit(name).alias("name"), "r.*"))
        return reduce(DataFrame.unionAll, parts).groupBy("element", "name", "property", "type").agg(F.sum("observations").alias("observations"))

    def match(self, name: str, label: str, where: Column | str | None = None) -> "Rows":
        return Rows(self, self.named(name, label, where), {name: label}, {})

    def named(self, name: str, label: str, where: Column | str | None = None) -> DataFrame:
        if label not in self.nodes:
            raise KeyError(f"no label {label}; there are {sorted(self.nodes)}")
        frame = self.nodes[label] if where is None else self.nodes[label].where(where)
        return frame.select([F.col(f"`{c}`").alias(f"{name}_{c}") for c in frame.columns])

    def stats(self) -> DataFrame:
        """``(source, kind, target, n)`` of all edge tables."""
        parts = [e.frame.agg(F.count("*").alias("n")).select(F.lit(e.source).alias("source"), F.lit(k).alias("kind"), F.lit(e.target).alias("target"), "n") for k, ts in self.edges.items() for e in ts]
        return reduce(DataFrame.unionByName, parts)

    def schema(self) -> DataFrame:
        """``(element, name, property, type)`` of all labels and kinds."""
        rows = [("node", label, c, t) for label, f in self.nodes.items() for c, t in f.dtypes]
        rows += [("edge", k, c, t) for k, ts in self.edges.items() for e in ts[:1] for c, t in e.frame.dtypes]
        return self.spark.createDataFrame(rows, "element string, name string, property string, type string")


@dataclass
class Rows:
    """Bindings of a pattern so far. ``rels`` maps a relationship's name to its kinds, for trail constraints."""

    graph: PropertyGraph
    frame: DataFrame
    labels: dict[str, str]
    rels: dict[str, frozenset]

    def _hop_frame(self, kinds, source: str, direction: str, target: str, rel: str) -> DataFrame:
        def one(flip: bool) -> list[DataFrame]:
            a, b = ("dst", "src") if flip else ("src", "dst")
            ends = {"source": target, "target": source} if flip else {"source": source, "target": target}
            out = []
            for e in self.graph.edge_tables(kinds, **ends):
                f = e.frame
                if direction == "both" and flip and source == target:
                    f = f.where("src <> dst")  # a loop is one match, not two
                out.append(f.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col("rid").alias(f"{rel}_rid"), *[F.col(c).alias(f"{rel}_{c}") for c in f.columns if c not in ("src", "dst", "rid")]))
            return out

        parts = (one(False) if direction in ("out", "both") else []) + (one(True) if direction in ("in", "both") else [])
        if not parts:
            raise KeyError(f"no {kinds} between {source} and {target}")
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    def hop(self, start: str, kinds, name: str, label: str, direction: str = "out", rel: str | None = None, where=None, rel_where=None, how: str = "inner") -> "Rows":
        """Follows relationships from ``start`` to ``name``, new or already bound (then it closes a cycle)."""
        rel = rel or f"_r{len(self.rels)}"
        edges = self._hop_frame(kinds, self.labels[start], direction, label, rel)
        if rel_where is not None:
            edges = edges.where(rel_where)
        names = frozenset([kinds] if isinstance(kinds, str) else kinds)
        if name in self.labels:
            on = (F.col(f"{start}_id") == F.col("_from")) & (F.col(f"{name}_id") == F.col("_to"))
            frame = self.frame.join(edges, on, how).drop("_from", "_to")
        else:
            nodes = self.graph.named(name, label, where)
            step = edges.join(nodes, F.col("_to") == F.col(f"{name}_id"))
            frame = self.frame.join(step, F.col(f"{start}_id") == F.col("_from"), how).drop("_from", "_to")
        for other, kinds_of in self.rels.items():
            if kinds_of & names and how == "inner":
                frame = frame.where(F.col(f"{other}_rid") != F.col(f"{rel}_rid"))
        return Rows(self.graph, frame, {**self.labels, name: label}, {**self.rels, rel: names})

    def where(self, condition) -> "Rows":
        return Rows(self.graph, self.frame.where(condition), self.labels, self.rels)

    def optional(self, start: str, kinds, name: str, label: str, **options) -> "Rows":
        """OPTIONAL MATCH: unmatched rows stay, with nulls; ``where`` belongs to the match."""
        return self.hop(start, kinds, name, label, how="left", **options)

    def clause(self) -> "Rows":
        """Starts another clause: later hops may take relationships that earlier ones took."""
        return Rows(self.graph, self.frame, self.labels, {})

    def optional_pattern(self, start: str, build) -> "Rows":
        """An optional pattern of several hops: it matches as a whole or not at all. ``build`` takes the rows of ``start`` alone."""
        inner = build(Rows(self.graph, self.graph.named(start, self.labels[start]), {start: self.labels[start]}, {}))
        own = [c for c in self.graph.named(start, self.labels[start]).columns if c != f"{start}_id"]
        frame = self.frame.join(inner.frame.drop(*own), f"{start}_id", "left")
        return Rows(self.graph, frame, {**inner.labels, **self.labels}, self.rels)

    def path(self, alias: str, *names: str) -> "Rows":
        """``<alias>``: the ids along the named elements, as text, and its length in hops."""
        ids = F.array(*[F.col(f"{n}_id").cast("string") for n in names])
        frame = self.frame.withColumn(alias, F.struct(ids.alias("nodes"), F.lit(len(names) - 1).alias("length")))
        return Rows(self.graph, frame, self.labels, self.rels)

    def having_label(self, name: str, label: str) -> "Rows":
        """Rows whose element is also among the nodes of another label (secondary labels share ids)."""
        other = self.graph.nodes[label].select(F.col("id").alias(f"{name}_id"))
        return Rows(self.graph, self.frame.join(other, f"{name}_id", "left_semi"), self.labels, self.rels)

    def _ends(self, start: str, kinds, label: str, direction: str, where=None, rel_where=None) -> DataFrame:
        edges = self._hop_frame(kinds, self.labels[start], direction, label, "r")
        edges = edges if rel_where is None else edges.where(rel_where)
        if where is not None:
            edges = edges.join(self.graph.named("e", label, where), F.col("_to") == F.col("e_id"))
        return edges

    def exists(self, start: str, kinds, label: str, direction: str = "out", where=None, rel_where=None, negate: bool = False) -> "Rows":
        found = self._ends(start, kinds, label, direction, where, rel_where).select("_from")
        frame = self.frame.join(found, F.col(f"{start}_id") == F.col("_from"), "left_anti" if negate else "left_semi")
        return Rows(self.graph, frame, self.labels, self.rels)

    def count(self, start: str, kinds, label: str, alias: str, direction: str = "out", where=None, rel_where=None) -> "Rows":
        """COUNT { pattern }: a number for each row, 0 where nothing matches."""
        n = self._ends(start, kinds, label, direction, where, rel_where).groupBy("_from").agg(F.count("*").alias(alias))
        frame = self.frame.join(n, F.col(f"{start}_id") == F.col("_from"), "left").drop("_from").withColumn(alias, F.coalesce(alias, F.lit(0)))
        return Rows(self.graph, frame, self.labels, self.rels)

    def paths(self, start: str, kind: str, name: str, least: int = 1, most: int = 10, direction: str = "out") -> "Rows":
        """Variable-length trails within one label: ``<name>_id``, ``<name>_hops`` and ``<name>_rids``."""
        label = self.labels[start]
        edges = self._hop_frame(kind, label, direction, label, "e").select("_from", "_to", F.col("e_rid").alias("_rid"))
        now = self.frame.withColumn(f"{name}_id", F.col(f"{start}_id")).withColumn(f"{name}_rids", F.array().cast("array<bigint>"))
        out = [now] if least == 0 else []
        for depth in range(1, most + 1):
            step = now.join(edges, F.col(f"{name}_id") == F.col("_from")).where(~F.array_contains(f"{name}_rids", F.col("_rid")))
            now = step.withColumn(f"{name}_rids", F.array_append(f"{name}_rids", F.col("_rid"))).withColumn(f"{name}_id", F.col("_to")).drop("_from", "_to", "_rid")
            if depth >= least:
                out.append(now)
        frame = reduce(DataFrame.unionByName, out).withColumn(f"{name}_hops", F.size(f"{name}_rids"))
        return Rows(self.graph, frame, {**self.labels, name: label}, self.rels)


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The driver's tables as a graph."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    strip = lambda f, p: f.withColumnsRenamed({c: c[len(p) :] for c in f.columns if c.startswith(p)})
    nation, customer, supplier, orders, line, events = t("nation"), t("customer"), t("supplier"), t("orders"), t("lineitem"), t("events")
    g = PropertyGraph(spark)
    g.add_nodes("Region", strip(t("region"), "r_"), "regionkey").add_nodes("Nation", strip(nation, "n_"), "nationkey")
    g.add_nodes("Customer", strip(customer, "c_"), "custkey").add_nodes("Supplier", strip(supplier, "s_"), "suppkey")
    g.add_nodes("Part", strip(t("part"), "p_"), "partkey").add_nodes("Order", strip(orders, "o_"), "orderkey")
    g.add_nodes("Event", events, "event_id").add_nodes("User", events.select("user_id").distinct(), "user_id")
    g.add_edges("IN_REGION", "Nation", "Region", nation.selectExpr("n_nationkey as src", "n_regionkey as dst", "bigint(n_nationkey) as rid"))
    g.add_edges("IN_NATION", "Customer", "Nation", customer.selectExpr("c_custkey as src", "c_nationkey as dst", "c_custkey as rid"))
    g.add_edges("IN_NATION", "Supplier", "Nation", supplier.selectExpr("s_suppkey as src", "s_nationkey as dst", "-s_suppkey as rid"))
    g.add_edges("PLACED", "Customer", "Order", orders.selectExpr("o_custkey as src", "o_orderkey as dst", "o_orderkey as rid"))
    lines = strip(line, "l_").withColumn("rid", F.xxhash64("orderkey", "linenumber", "partkey", "suppkey"))
    props = ["rid", "linenumber", "quantity", "extendedprice", "discount", "returnflag", "shipdate"]
    g.add_edges("CONTAINS", "Order", "Part", lines.select(F.col("orderkey").alias("src"), F.col("partkey").alias("dst"), *props, "suppkey"))
    g.add_edges("SUPPLIED_BY", "Order", "Supplier", lines.select(F.col("orderkey").alias("src"), F.col("suppkey").alias("dst"), *props))
    g.add_edges("DID", "User", "Event", events.selectExpr("user_id as src", "event_id as dst", "event_id as rid"))
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g.add_edges("NEXT", "Event", "Event", events.select(F.col("event_id").alias("src"), after.alias("dst"), F.col("event_id").alias("rid")).where("dst is not null"))
    return g
