"""Queries over the function families, writes, patterns and selections; SQL states each rule in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.catalog_queries import _series, query
from latticework.functions import dates as D
from latticework.functions import lists as L
from latticework.functions import numbers as N
from latticework.functions import text as T
from latticework.functions import timeseries as TS
from latticework.operators import paths as P
from latticework.operators.selection import Selection

#: Part names with white space around them, and nulls.
NAMES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN concat(' ', chr(9), p_name, '-', p_brand, '  ') END AS s FROM part"


def _names(g):
    s = F.when(F.col("id") % 10 != 0, F.concat(F.lit(" \t"), "name", F.lit("-"), "brand", F.lit("  ")))
    return g.nodes["Part"].select("id", s.alias("s"))


@query(
    "text_rules",
    f"""SELECT id, lower(s) AS low, trim(s, ' ' || chr(9)) AS bare, ltrim(s, ' ' || chr(9)) AS after, rtrim(s) AS before, array_to_string(string_split(s, '#'), '|') AS parts,
    s[1:5] AS head, s[-4:] AS tail, trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm,
    contains(s, 'a') OR contains(s, '#3') AS some, starts_with(s, ' ' || chr(9)) OR starts_with(s, 'x') AS starts, regexp_matches(s, '(?i)BRAND#[12]') AS hit
    FROM ({NAMES})""",
)
def text_rules(g):
    return _names(g).select(
        "id", F.lower("s").alias("low"), T.trim("s").alias("bare"), T.ltrim("s").alias("after"), T.rtrim("s").alias("before"), F.array_join(T.split("s", "#"), "|").alias("parts"),
        T.left("s", 5).alias("head"), T.right("s", 4).alias("tail"), T.normalize("s").alias("norm"), T.contains_any("s", ["a", "#3"]).alias("some"), T.starts_with_any("s", [" \t", "x"]).alias("starts"), T.matches("s", "BRAND#[12]", "i").alias("hit"),
    )


@query(
    "text_similarity",
    """SELECT p_partkey AS id, round(len(list_intersect(x, y)) / len(list_distinct(x || y))::double, 9) AS alike, array_to_string([p_brand[i : i + 2] FOR i IN range(1, length(p_brand) - 1)], ',') AS grams, length(p_type) AS n
    FROM (SELECT *, list_distinct(list_filter(string_split(p_name, ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(p_type, ' '), lambda w: w <> '')) AS y FROM part)""",
)
def text_similarity(g):
    return g.nodes["Part"].select("id", F.round(T.jaccard("name", "type"), 9).alias("alike"), F.array_join(T.ngrams("brand", 3), ",").alias("grams"), F.char_length("type").cast("long").alias("n"))


@query(
    "numeric_rules",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS whole, CASE WHEN s_suppkey % 3 <> 2 THEN s_suppkey::double END AS real,
    sign(x) * floor(abs(x) + 0.5) AS near, CASE WHEN x >= 0 THEN round(sqrt(greatest(x, 0)), 9) END AS root, CASE WHEN abs(x) <= 1 THEN round(asin(greatest(least(x, 1), -1)), 9) END AS arc, CASE WHEN abs(x) <= 1 THEN round(acos(greatest(least(x, 1), -1)), 9) END AS arc2,
    CASE WHEN x > 0 THEN round(log10(CASE WHEN x > 0 THEN x ELSE 1 END), 9) END AS lg, round(exp(x / 100), 6) AS e, round(pow(abs(x) + 1, 1.5), 4) AS p, round(tan(x), 6) AS t, round(pow(sin(x / 2), 2), 9) AS h, round(x * pi() / 180, 9) AS r
    FROM (SELECT s_suppkey, (s_suppkey - 50) / 2.0 AS x FROM supplier)""",
)
def numeric_rules(g):
    x = (F.col("id") - 50) / F.lit(2.0)
    said = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, F.concat(F.col("id").cast("string"), F.lit(".0"))).otherwise("x1")
    return g.nodes["Supplier"].select(
        "id", N.to_integer(said).alias("whole"), N.to_float(said).alias("real"), N.round_half_away(x).alias("near"), F.round(N.sqrt(x), 9).alias("root"), F.round(N.asin(x), 9).alias("arc"), F.round(N.acos(x), 9).alias("arc2"),
        F.round(N.log10(x), 9).alias("lg"), F.round(F.exp(x / 100), 6).alias("e"), F.round(N.power(F.abs(x) + 1, F.lit(1.5)), 4).alias("p"), F.round(F.tan(x), 6).alias("t"), F.round(N.haversin(x), 9).alias("h"), F.round(F.radians(x), 9).alias("r"),
    )


@query(
    "date_rules",
    """SELECT o_orderkey AS id, make_date(year(d), 1, 1) AS y, make_date(year(d), month(d), 1) AS m, d AS day, CAST(NULL AS date) AS bad, date_diff('day', DATE '1995-01-01', d) AS n,
    CAST(d + INTERVAL 2 YEAR AS date) AS later, CAST(date_trunc('week', d) AS date) AS week, CAST(date_trunc('month', d) AS date) AS first, date_diff('second', TIMESTAMP '1995-01-01 06:00:00', d::timestamp) AS seconds
    FROM (SELECT o_orderkey, o_orderdate::date AS d FROM orders)""",
)
def date_rules(g):
    d = F.col("orderdate").cast("date")
    between = D.duration_between(F.lit("1995-01-01 06:00:00").cast("timestamp"), d)
    return g.nodes["Order"].select(
        "id", D.date_of(F.date_format(d, "yyyy")).alias("y"), D.date_of(F.date_format(d, "yyyy-M")).alias("m"), D.date_of(F.date_format(d, "yyyy-M-d")).alias("day"), D.date_of(F.lit("soon")).alias("bad"), D.days_between(d, F.lit("1995-01-01").cast("date")).alias("n"),
        D.add_years(d, 2).alias("later"), D.truncate(d, "week").alias("week"), D.truncate(d, "month").alias("first"), (between["days"] * 86_400 + between["seconds"]).cast("long").alias("seconds"),
    )


LISTS = "SELECT o_custkey AS id, list(CASE WHEN o_totalprice > 100000 THEN o_orderkey END ORDER BY o_orderkey) AS x, count(*) FILTER (o_totalprice > 100000 AND o_orderkey % 2 = 0) AS yes, count(*) FILTER (o_totalprice <= 100000) AS nulls, count(*) AS n FROM orders GROUP BY 1"


@query(
    "list_rules",
    f"""SELECT id, x[1] AS head, x[n] AS last, x[2] AS second, x[n - 1] AS before, len(x[2:3]) AS cut, n * (n + 1) // 2 AS total,
    CASE WHEN yes > 0 THEN true WHEN nulls > 0 THEN NULL ELSE false END AS some, CASE WHEN yes < n - nulls THEN false WHEN nulls > 0 THEN NULL ELSE true END AS every,
    CASE WHEN yes > 0 THEN false WHEN nulls > 0 THEN NULL ELSE true END AS none, CASE WHEN yes > 1 THEN false WHEN nulls > 0 THEN NULL ELSE yes = 1 END AS single FROM ({LISTS})""",
)
def list_rules(g):
    pair = F.struct("id", F.when(F.col("totalprice") > 100000, F.col("id")).alias("v"))
    x = g.nodes["Order"].groupBy(F.col("custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["v"]).alias("x"))
    even = lambda v: v % 2 == 0
    total = F.aggregate(L.numbers(F.lit(1).cast("long"), F.size("x").cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select(
        "id", L.head("x").alias("head"), L.last("x").alias("last"), L.at("x", 1).alias("second"), L.at("x", -2).alias("before"), F.size(L.cut("x", 1, 3)).cast("long").alias("cut"), total.alias("total"),
        L.any_of("x", even).alias("some"), L.all_of("x", even).alias("every"), L.none_of("x", even).alias("none"), L.single_of("x", even).alias("single"),
    )


@query(
    "series_ranges",
    """SELECT k.id, k.channel, round(coalesce(sum(value), 0), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(value) AS n, arg_min(value, ts) AS first, arg_max(value, ts) AS last
    FROM (SELECT DISTINCT user_id AS id, event_type AS channel FROM events) k LEFT JOIN events ON user_id = id AND event_type = channel AND ts >= (SELECT date_trunc('month', min(ts)) FROM events) AND ts < (SELECT date_trunc('month', min(ts)) + INTERVAL 1 MONTH FROM events) GROUP BY ALL""",
)
def series_ranges(g):
    month = g.nodes["Event"].agg(F.date_format(F.min("ts"), "yyyy-MM")).first()[0]
    s = TS.summary(_series(g), month)
    return s.select("id", "channel", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), F.col("min").alias("low"), F.col("max").alias("high"), F.col("count").alias("n"), "first", "last")


@query(
    "optional_two_hops",
    "SELECT c_custkey AS id, count(l_partkey) AS parts, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey AND p_size > 45) ON o_custkey = c_custkey GROUP BY 1",
)
def optional_two_hops(g):
    rows = g.match("c", "Customer").optional_pattern("c", lambda r: r.hop("c", "PLACED", "o", "Order").hop("o", "CONTAINS", "p", "Part", where="size > 45"))
    return rows.frame.groupBy(F.col("c_id").alias("id")).agg(F.count("p_id").alias("parts"), F.count("*").alias("n"))


@query("clause_boundary", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
def clause_boundary(g):
    rows = g.match("p", "Part").hop("p", "CONTAINS", "o", "Order", direction="in").clause().hop("o", "CONTAINS", "q", "Part")
    return rows.frame.agg(F.count("*").alias("n"))


@query("named_path", "SELECT c_custkey::varchar || '>' || n_nationkey || '>' || n_regionkey AS path, 2 AS hops FROM customer JOIN nation ON n_nationkey = c_nationkey")
def named_path(g):
    rows = g.match("c", "Customer").hop("c", "IN_NATION", "n", "Nation").hop("n", "IN_REGION", "r", "Region").path("p", "c", "n", "r")
    return rows.frame.select(F.array_join("p.nodes", ">").alias("path"), F.col("p.length").alias("hops"))


@query("shortest_paths", "WITH n AS (SELECT event_id AS a, ts, lead(event_id) OVER w AS b, lead(event_id, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a, c AS b, 2 AS hops, concat(a, '>', b, '>', c) AS path FROM n WHERE c IS NOT NULL")
def shortest_paths(g):
    two = g.match("a", "Event").hop("a", "NEXT", "x", "Event").hop("x", "NEXT", "b", "Event").frame.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return P.shortest_paths(two, g.all_edges("NEXT"), most=2).select("a", "b", "hops", F.array_join("path", ">").alias("path"))


@query("cross_type_search", "SELECT label, property, count(*) AS n FROM (SELECT 'Customer' AS label, 'name' AS property FROM customer WHERE contains(lower(c_name), '7') UNION ALL SELECT 'Customer', 'mktsegment' FROM customer WHERE contains(lower(c_mktsegment), '7') UNION ALL SELECT 'Supplier', 'name' FROM supplier WHERE contains(lower(s_name), '7')) GROUP BY 1, 2")
def cross_type_search(g):
    return g.search("7", ["Customer", "Supplier"]).groupBy("label", "property").agg(F.count("*").alias("n"))


@query("secondary_label", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 5")
def secondary_label(g):
    g.add_nodes("Rich", g.nodes["Customer"].where("acctbal > 5000"))
    return g.match("c", "Customer", "nationkey < 5").having_label("c", "Rich").frame.select(F.col("c_id").alias("id"))


@query("write_set_remove", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN -1.0 ELSE s_acctbal END AS acctbal, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name FROM supplier UNION ALL SELECT 1000001, 7.5, 'new'")
def write_set_remove(g):
    new = g.spark.createDataFrame([(1_000_001, 7.5, "new")], "id long, acctbal double, name string")
    g.set_properties("Supplier", g.nodes["Supplier"].where("id % 4 = 0").select("id", F.lit(-1.0).alias("acctbal")))
    g.remove_property("Supplier", "name", "id % 5 = 0").create_nodes("Supplier", new)
    return g.nodes["Supplier"].select("id", "acctbal", "name")


@query("write_delete", "SELECT 'customers' AS what, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 7 <> 0")
def write_delete(g):
    g.delete_nodes("Customer", g.nodes["Customer"].where("id % 3 = 0"), detach=True).delete_edges("PLACED", "dst % 7 = 0")
    counts = [f.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, f in (("customers", g.nodes["Customer"]), ("orders", g.all_edges("PLACED")))]
    return counts[0].unionAll(counts[1])


@query("write_edges", "SELECT o_custkey AS src, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, 1 FROM orders WHERE o_custkey % 2 = 1")
def write_edges(g):
    odd = g.all_edges("PLACED").where("src % 2 = 1").groupBy("src").agg(F.min("dst").alias("dst"))
    g.replace_edges("PLACED", "Customer", "Order", odd)
    return g.all_edges("PLACED").groupBy("src").agg(F.count("*").alias("n"))


@query("merge_edges", "SELECT src, dst, sum(w)::bigint AS w FROM (SELECT c_nationkey AS src, s_nationkey AS dst, 1 AS w FROM customer JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT n_nationkey, n_nationkey, 10 FROM nation) GROUP BY 1, 2")
def merge_edges(g):
    pairs = g.nodes["Customer"].select("id", F.col("nationkey").alias("src")).join(g.nodes["Supplier"].select("id", F.col("nationkey").alias("dst")), "id")
    g.add_edges("LINK", "Nation", "Nation", pairs.groupBy("src", "dst").agg(F.count("*").alias("w")))
    g.merge_edges("LINK", "Nation", "Nation", g.nodes["Nation"].select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(10).cast("long").alias("w")), "sum")
    return g.all_edges("LINK").select("src", "dst", "w")


@query("property_keys", "SELECT 'node' AS element, 'Event' AS name, 'props' AS property, 'string' AS type, count(props) AS observations FROM events UNION ALL SELECT 'edge', 'CONTAINS', 'quantity', 'double', count(l_quantity) FROM lineitem UNION ALL SELECT 'node', 'Part', 'size', 'int', count(p_size) FROM part")
def property_keys(g):
    return g.property_keys().where("(name = 'Event' and property = 'props') or (name = 'CONTAINS' and property = 'quantity') or (name = 'Part' and property = 'size')")


@query("select_levels", "SELECT o_custkey AS parent, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_orderstatus = 'O') WHERE k <= 2")
def select_levels(g):
    return Selection.of(g, "Customer").where(acctbal={">": 0}).levels("PLACED", "Order", where="orderstatus = 'O'", top=("totalprice", 2)).select("parent", "id")


@query("select_add_properties", "SELECT c_custkey AS id, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def select_add_properties(g):
    s = Selection.of(g, "Customer").add_properties("PLACED", "Order", {"orders": "count(id)", "spent": "round(sum(totalprice), 2)"})
    return s.frame.select("id", "orders", "spent")


@query("select_count_unique", "SELECT c_mktsegment AS mktsegment, count(*) AS n, (SELECT count(DISTINCT c_nationkey) FROM customer) AS nations FROM customer GROUP BY 1")
def select_count_unique(g):
    s = Selection.of(g, "Customer")
    return s.count("mktsegment").withColumn("nations", F.lit(s.unique_values("nationkey").count()))
