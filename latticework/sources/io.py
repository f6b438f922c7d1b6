"""Sources and sinks of graphs: records, CSV specs, N-Triples, snapshots and text exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.plans.graph import PropertyGraph


def merge_nodes(known: DataFrame, new: DataFrame, mode: str = "update") -> DataFrame:
    """Upsert by id. update: new values win where not null; preserve: old ones do; replace: new rows whole; skip: old rows whole; sum: numbers add up."""
    if mode in ("replace", "skip"):
        first, second = (new, known) if mode == "replace" else (known, new)
        return first.unionByName(second.join(first.select("id"), "id", "left_anti"), allowMissingColumns=True)
    types = {**dict(new.dtypes), **dict(known.dtypes)}
    a, b = known.alias("a"), new.alias("b")
    columns = []
    for c, t in types.items():
        left, right = (F.col(f"a.{c}") if c in known.columns else F.lit(None).cast(t)), (F.col(f"b.{c}") if c in new.columns else F.lit(None).cast(t))
        if c == "id" or mode == "preserve":
            value = F.coalesce(left, right)
        elif mode == "sum" and t in ("int", "bigint", "double", "float"):
            value = F.when(left.isNull(), right).when(right.isNull(), left).otherwise(left + right)
        else:
            value = F.coalesce(right, left)
        columns.append(value.alias(c))
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(*columns)


def from_records(spark: SparkSession, spec: dict) -> PropertyGraph:
    """``{"nodes": {label: [rows with id]}, "edges": [{"type", "source", "target", "rows": [{"src", "dst", …}]}]}``."""
    g = PropertyGraph(spark)
    for label, rows in spec.get("nodes", {}).items():
        g.add_nodes(label, spark.createDataFrame(rows))
    for e in spec.get("edges", []):
        g.add_edges(e["type"], e["source"], e["target"], spark.createDataFrame(e["rows"]), stubs=e.get("stubs", True))
    return g


def load_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """All columns as text, empty fields null; nothing is guessed, so files are read once."""
    return spark.read.option("header", header).option("sep", separator).option("nullValue", "").option("emptyValue", "").csv(path)


def from_csv_spec(spark: SparkSession, root: str, spec: dict) -> PropertyGraph:
    """``{"nodes": {label: {"file", "types"?: {column: type, else text}, "id", "filter"?, "derive"?: {name: sql}, "parents"?: {column: [kind, label]}}}, "junctions": [{"file", "type", "source", "src", "target", "dst"}]}``."""
    types = {**{s["file"]: s.get("types", {}) for s in spec.get("nodes", {}).values() if "file" in s}, **{j["file"]: j.get("types", {}) for j in spec.get("junctions", [])}}

    def read(name: str) -> DataFrame:
        frame = load_csv(spark, f"{root}/{name}")
        return frame.withColumns({c: F.col(c).cast(t) for c, t in types[name].items()}) if types[name] else frame

    g = PropertyGraph(spark)
    for label, s in spec.get("nodes", {}).items():
        frame = read(s["file"]) if "file" in s else s["frame"]
        for name, sql in s.get("derive", {}).items():
            frame = frame.withColumn(name, F.expr(sql))
        frame = frame.where(s["filter"]) if "filter" in s else frame
        g.add_nodes(label, frame, s["id"])
        for column, (kind, target) in s.get("parents", {}).items():
            g.add_edges(kind, label, target, frame.where(F.col(column).isNotNull()).select(F.col(s["id"]).alias("src"), F.col(column).alias("dst")))
    for j in spec.get("junctions", []):
        g.add_edges(j["type"], j["source"], j["target"], read(j["file"]), j["src"], j["dst"])
    return g


NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)\s*(?:<[^>]*>)?\s*\.\s*$'


def read_triples(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """N-Triples or N-Quads to ``(subject, predicate, object, literal, language, datatype)``; other lines are ignored."""
    line = spark.read.text(path)
    part = lambda k: F.regexp_extract("value", NT, k)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    rows = line.where(F.col("value").rlike(NT)).select(
        bare(part(1)).alias("subject"), part(2).alias("predicate"), F.nullif(bare(part(3)), F.lit("")).alias("object"),
        F.when(part(3) == "", part(4)).alias("literal"), F.nullif(part(5), F.lit("")).alias("language"), F.nullif(part(6), F.lit("")).alias("datatype"),
    )
    return rows if languages is None else rows.where(F.col("language").isNull() | F.col("language").isin(languages))


def save(graph: PropertyGraph, root: str) -> None:
    """Parquet per label and edge table, and a manifest."""
    manifest = {"nodes": sorted(graph.nodes), "edges": [[k, e.source, e.target] for k, ts in graph.edges.items() for e in ts]}
    for label, frame in graph.nodes.items():
        frame.write.mode("overwrite").parquet(f"{root}/nodes/{label}")
    for kind, tables in graph.edges.items():
        for e in tables:
            e.frame.write.mode("overwrite").parquet(f"{root}/edges/{kind}/{e.source}/{e.target}")
    graph.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")


def load(spark: SparkSession, root: str) -> PropertyGraph:
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()[0])
    g = PropertyGraph(spark)
    for label in manifest["nodes"]:
        g.add_nodes(label, spark.read.parquet(f"{root}/nodes/{label}"))
    for kind, source, target in manifest["edges"]:
        g.add_edges(kind, source, target, spark.read.parquet(f"{root}/edges/{kind}/{source}/{target}"))
    return g


def graphml_lines(graph: PropertyGraph) -> DataFrame:
    """``(part, line)``: node and edge elements; write them between a header and a footer."""
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    out = None
    for label, f in graph.nodes.items():
        data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), esc(F.col(c)), F.lit("</data>"))).otherwise("") for c in f.columns if c != "id"]
        part = f.select(F.lit("node").alias("part"), F.concat(F.lit(f'<node id="{label}:'), esc(F.col("id")), F.lit('">'), *data, F.lit("</node>")).alias("line"))
        out = part if out is None else out.unionByName(part)
    for kind, tables in graph.edges.items():
        for e in tables:
            text = F.concat(F.lit(f'<edge source="{e.source}:'), esc(F.col("src")), F.lit(f'" target="{e.target}:'), esc(F.col("dst")), F.lit(f'" label="{kind}"/>'))
            out = out.unionByName(e.frame.select(F.lit("edge").alias("part"), text.alias("line")))
    return out


def d3_lines(graph: PropertyGraph) -> DataFrame:
    """A JSON line per node and link."""
    out = None
    for label, f in graph.nodes.items():
        part = f.select(F.to_json(F.struct(F.lit("node").alias("part"), F.lit(label).alias("label"), *[F.col(c) for c in f.columns])).alias("line"))
        out = part if out is None else out.unionByName(part)
    for kind, tables in graph.edges.items():
        for e in tables:
            out = out.unionByName(e.frame.select(F.to_json(F.struct(F.lit("link").alias("part"), F.lit(kind).alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"))).alias("line")))
    return out
