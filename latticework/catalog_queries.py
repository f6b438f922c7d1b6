"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.functions import scalars as S
from latticework.functions import timeseries as TS
from latticework.operators import algorithms as A
from latticework.operators import communities
from latticework.operators import paths as P
from latticework.operators import rules as R
from latticework.operators import spatial as SP
from latticework.operators.selection import Selection
from latticework.plans import compute as C
from latticework.plans.graph import PropertyGraph, trade_graph
from latticework.sources import io
from latticework.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the trade graph."""

    def register(f: Callable[[PropertyGraph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(trade_graph(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their balance by nation: a hop, a filter and an aggregate."""
    return one_hop_aggregate(trade_graph(spark, sf_dir))


@query("one_hop_aggregate", "SELECT n_name AS nation, count(*) AS customers, round(avg(c_acctbal), 6) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def one_hop_aggregate(g):
    rows = g.match("c", "Customer", "acctbal > 0").hop("c", "IN_NATION", "n", "Nation").frame
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("avg_bal")).orderBy(F.desc("customers"), "nation").limit(10)


# --- scans and predicates


@query("node_scan", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def node_scan(g):
    return g.match("c", "Customer").frame.select(F.col("c_id").alias("id"), F.col("c_mktsegment").alias("segment"))


@query("node_scan_all_labels", "SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part")
def node_scan_all_labels(g):
    parts = [g.nodes[label].select(F.lit(label).alias("label")) for label in ("Customer", "Supplier", "Part")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("label").agg(F.count("*").alias("n"))


@query("point_lookup", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey IN (1, 7, 32, 100)")
def point_lookup(g):
    return g.match("o", "Order", F.col("id").isin(1, 7, 32, 100)).frame.select(F.col("o_id").alias("id"), F.col("o_totalprice").alias("price"))


@query("range_filter", "SELECT count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice > 1000")
def range_filter(g):
    return g.match("p", "Part", "size between 10 and 20 and retailprice > 1000").frame.agg(F.count("*").alias("n"))


@query("string_predicates", "SELECT p_partkey AS id FROM part WHERE (starts_with(p_type, 'S') OR ends_with(p_type, 'L')) AND contains(p_name, 'a')")
def string_predicates(g):
    t = F.col("type")
    return g.match("p", "Part", (t.startswith("S") | t.endswith("L")) & F.col("name").contains("a")).frame.select(F.col("p_id").alias("id"))


@query("regex_full_match", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].*') GROUP BY 1")
def regex_full_match(g):
    return g.match("p", "Part", F.col("brand").rlike("^(?:Brand#[1-3].*)$")).frame.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("edge_scan", "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def edge_scan(g):
    return g.all_edges("CONTAINS").groupBy(F.col("returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


# --- patterns


@query("two_hop", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def two_hop(g):
    rows = g.match("c", "Customer").hop("c", "IN_NATION", "n", "Nation").hop("n", "IN_REGION", "r", "Region").frame
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))


@query("edge_properties", "SELECT p_brand AS brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30 AND o_orderstatus = 'F' GROUP BY 1")
def edge_properties(g):
    rows = g.match("o", "Order", "orderstatus = 'F'").hop("o", "CONTAINS", "p", "Part", rel="l", rel_where="l_quantity > 30").frame
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("incoming_hop", "SELECT n_name AS nation, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def incoming_hop(g):
    return g.match("n", "Nation").hop("n", "IN_NATION", "s", "Supplier", direction="in").frame.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("suppliers"))


@query("undirected_hop", "SELECT event_id AS id, count(*) AS n FROM (SELECT event_id, lead(event_id) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) UNION ALL SELECT event_id, lag(event_id) OVER w FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x IS NOT NULL GROUP BY 1")
def undirected_hop(g):
    return g.match("a", "Event").hop("a", "NEXT", "b", "Event", direction="both").frame.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"))


@query("type_alternation", "SELECT kind, count(*) AS n FROM (SELECT 'part' AS kind FROM lineitem UNION ALL SELECT 'supplier' FROM lineitem) GROUP BY 1")
def type_alternation(g):
    both = g.all_edges("CONTAINS").select(F.lit("part").alias("kind")).unionAll(g.all_edges("SUPPLIED_BY").select(F.lit("supplier").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("cyclic_pattern", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey")
def cyclic_pattern(g):
    rows = g.match("c", "Customer").hop("c", "PLACED", "o", "Order").hop("o", "SUPPLIED_BY", "s", "Supplier").hop("s", "IN_NATION", "n", "Nation").hop("c", "IN_NATION", "n", "Nation")
    return rows.frame.agg(F.count("*").alias("n"))


@query("relationship_uniqueness", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE (a.l_linenumber, a.l_partkey, a.l_suppkey) <> (b.l_linenumber, b.l_partkey, b.l_suppkey)")
def relationship_uniqueness(g):
    rows = g.match("p", "Part").hop("p", "CONTAINS", "o", "Order", direction="in").hop("o", "CONTAINS", "q", "Part")
    return rows.frame.agg(F.count("*").alias("n"))


@query("optional_match", "SELECT c_custkey AS id, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
def optional_match(g):
    rows = g.match("c", "Customer").optional("c", "PLACED", "o", "Order", where="totalprice > 200000").frame
    return rows.groupBy(F.col("c_id").alias("id")).agg(F.count("o_id").alias("orders"))


@query("exists_pattern", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_pattern(g):
    return g.match("c", "Customer").exists("c", "PLACED", "Order", where="orderpriority = '1-URGENT'").frame.select(F.col("c_id").alias("id"))


@query("not_exists_pattern", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_pattern(g):
    return g.match("c", "Customer").exists("c", "PLACED", "Order", negate=True).frame.select(F.col("c_id").alias("id"))


@query("count_subquery", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open FROM customer")
def count_subquery(g):
    return g.match("c", "Customer").count("c", "PLACED", "Order", "open", where="orderstatus = 'O'").frame.select(F.col("c_id").alias("id"), "open")


#: How many events each user has; consecutive ones are linked.
CHAINS = "WITH u AS (SELECT count(*) AS k FROM events GROUP BY user_id) "


@query("var_length_paths", CHAINS + "SELECT h AS hops, sum(greatest(k - h, 0))::bigint AS n FROM u, (SELECT unnest(range(1, 4)) AS h) GROUP BY 1 HAVING n > 0")
def var_length_paths(g):
    return g.match("a", "Event").paths("a", "NEXT", "p", 1, 3).frame.groupBy(F.col("p_hops").alias("hops")).agg(F.count("*").alias("n"))


@query("var_length_from_zero", CHAINS + "SELECT sum(k + greatest(k - 1, 0) + greatest(k - 2, 0))::bigint AS n FROM u")
def var_length_from_zero(g):
    return g.match("a", "Event").paths("a", "NEXT", "p", 0, 2).frame.agg(F.count("*").alias("n"))


@query("reachable_within", "SELECT event_id AS id, least(after, 10) AS reached FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM events) WHERE after > 0")
def reachable_within(g):
    far = A.hops_from(g.nodes["Event"].select("id"), g.all_edges("NEXT"), most=10).where("hops > 0")
    return far.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("reached"))


def shortest_path_length(g, most: int | None = 20):
    """Pairs of events by their distance, ``most`` hops at most; the registered query has no such bound."""
    if most is None:
        return A.hop_counts(g.nodes["Event"].select("id"), g.all_edges("NEXT"))
    far = A.hops_from(g.nodes["Event"].select("id"), g.all_edges("NEXT"), most=most).where("hops > 0")
    return far.groupBy("hops").agg(F.count("*").alias("n"))


@query("shortest_path_length", CHAINS + "SELECT h AS hops, sum(greatest(k - h, 0))::bigint AS n FROM u, (SELECT unnest(range(1, (SELECT max(k) FROM u))) AS h) GROUP BY 1 HAVING n > 0")
def all_path_lengths(g):
    return shortest_path_length(g, None)


# --- aggregates, windows, order, sets


@query("aggregate_statistics", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high, round(stddev_samp(c_acctbal), 5) AS sd, round(stddev_pop(c_acctbal), 5) AS sdp, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def aggregate_statistics(g):
    a = F.col("acctbal")
    return g.nodes["Customer"].groupBy(F.col("mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum(a), 2).alias("total"), F.round(F.avg(a), 6).alias("mean"), F.min(a).alias("low"), F.max(a).alias("high"), F.round(F.stddev_samp(a), 5).alias("sd"), F.round(F.stddev_pop(a), 5).alias("sdp"), F.countDistinct("nationkey").alias("nations"))


@query("percentiles", "SELECT p_brand AS brand, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(median(p_retailprice), 6) AS mid, quantile_disc(p_size, 0.5) AS size_mid FROM part GROUP BY 1")
def percentiles(g):
    return g.nodes["Part"].groupBy("brand").agg(F.expr("round(percentile_cont(0.9) within group (order by retailprice), 6)").alias("p90"), F.round(F.median("retailprice"), 6).alias("mid"), F.expr("percentile_disc(0.5) within group (order by size)").cast("int").alias("size_mid"))


@query("mode_of_ties", "SELECT seg AS segment, min(nk) AS nation FROM (SELECT c_mktsegment AS seg, c_nationkey AS nk, rank() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def mode_of_ties(g):
    n = g.nodes["Customer"].groupBy("mktsegment", "nationkey").agg(F.count("*").alias("n"))
    best = n.groupBy(F.col("mktsegment").alias("segment")).agg(F.min(F.struct(-F.col("n"), "nationkey")).alias("b"))
    return best.select("segment", F.col("b.nationkey").alias("nation"))


@query("collect_sorted", "SELECT r_name AS region, array_to_string(list(n_name ORDER BY n_name), ',') AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def collect_sorted(g):
    rows = g.match("n", "Nation").hop("n", "IN_REGION", "r", "Region").frame
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query("having", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def having(g):
    return g.match("c", "Customer").hop("c", "PLACED", "o", "Order").frame.groupBy(F.col("c_id").alias("id")).agg(F.count("*").alias("n")).where("n > 15")


@query("nested_aggregate", "SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def nested_aggregate(g):
    return g.all_edges("PLACED").groupBy("src").agg(F.count("*").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))


@query("window_ranks", "SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS dr FROM part")
def window_ranks(g):
    w = Window.partitionBy("brand").orderBy(F.desc("size"))
    return g.nodes["Part"].select("id", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("size"), "id")).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))


@query("top_k", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
def top_k(g):
    return g.nodes["Order"].select("id", F.col("totalprice").alias("price")).orderBy(F.desc_nulls_first("price"), "id").limit(25)


@query("skip_limit", "SELECT s_suppkey AS id FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10 OFFSET 20")
def skip_limit(g):
    return g.nodes["Supplier"].orderBy(F.asc_nulls_last("acctbal"), "id").select("id").offset(20).limit(10)


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(g):
    return g.nodes["Customer"].select(F.col("nationkey").alias("k")).union(g.nodes["Supplier"].select("nationkey")).distinct()


@query("set_intersect", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersect(g):
    e = g.all_edges("CONTAINS")
    return e.where("returnflag = 'R'").select(F.col("dst").alias("id")).intersect(e.where("returnflag = 'A'").select("dst"))


@query("set_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(g):
    late = g.match("c", "Customer").hop("c", "PLACED", "o", "Order", where="orderstatus = 'F'").frame.select("c_id")
    return g.nodes["Customer"].select("id").subtract(late)


@query("correlated_top_k", "SELECT id, k, price FROM (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, o_totalprice AS price FROM orders) WHERE k <= 2")
def correlated_top_k(g):
    rows = g.match("c", "Customer").hop("c", "PLACED", "o", "Order").frame
    k = F.row_number().over(Window.partitionBy("c_id").orderBy(F.desc("o_totalprice"), "o_id"))
    return rows.select(F.col("c_id").alias("id"), k.alias("k"), F.col("o_totalprice").alias("price")).where("k <= 2")




ORACLE["unwind_list"] = "SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS k, round(unnest(embedding)::double, 5) AS x FROM embeddings"
QUERIES["unwind_list"] = lambda spark, d: spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("p", "v")).select("id", (F.col("p") + 1).cast("long").alias("k"), F.round(F.col("v").cast("double"), 5).alias("x"))


@query("list_functions", "SELECT n_nationkey AS id, len(list_filter(string_split(n_name, ''), lambda x: x IN ('A', 'E', 'I', 'O', 'U'))) AS vowels, list_reduce(list_transform(string_split(n_name, ''), lambda x: 1), lambda a, b: a + b) AS letters FROM nation")
def list_functions(g):
    letters = F.filter(F.split("name", ""), lambda x: x != "")
    return g.nodes["Nation"].select("id", F.size(F.filter(letters, lambda x: x.isin("A", "E", "I", "O", "U"))).cast("long").alias("vowels"), F.aggregate(letters, F.lit(0), lambda a, b: a + 1).alias("letters"))


@query("quantifiers", "SELECT o_custkey AS id, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 300000) AS some, count(*) FILTER (o_orderstatus = 'P') = 1 AS single FROM orders GROUP BY 1")
def quantifiers(g):
    rows = g.match("c", "Customer").hop("c", "PLACED", "o", "Order").frame.groupBy(F.col("c_id").alias("id"))
    return rows.agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every"), F.bool_or(F.col("o_totalprice") > 300000).alias("some"), (F.count_if(F.col("o_orderstatus") == "P") == 1).alias("single"))


@query("case_expression", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class, count(*) AS n FROM customer GROUP BY 1")
def case_expression(g):
    c = F.when(F.col("acctbal") < 0, "debt").when(F.col("acctbal") < 5000, "some").otherwise("rich")
    return g.nodes["Customer"].groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("json_property", "SELECT event_type AS kind, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1")
def json_property(g):
    return g.nodes["Event"].groupBy(F.col("event_type").alias("kind")).agg(F.count(F.get_json_object("props", "$.k")).alias("n"))


@query("string_functions", "SELECT p_partkey AS id, upper(p_name) AS up, reverse(p_brand) AS back, length(p_type) AS n, substring(p_name, 2, 3) AS part, replace(p_brand, '#', '-') AS dashed, lpad(p_brand, 12, '.') AS padded, split_part(p_name, ' ', 1) AS head FROM part")
def string_functions(g):
    return g.nodes["Part"].select("id", F.upper("name").alias("up"), F.reverse("brand").alias("back"), F.length("type").cast("long").alias("n"), F.substring("name", 2, 3).alias("part"), F.replace("brand", F.lit("#"), F.lit("-")).alias("dashed"), F.lpad("brand", 12, ".").alias("padded"), F.split_part("name", F.lit(" "), F.lit(1)).alias("head"))


@query("text_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def text_distance(g):
    a, b = (g.nodes["Nation"].select(F.col("id").alias(k), F.col("name").alias(f"n{k}"), F.col("regionkey").alias("r")) for k in "ab")
    return a.join(b, "r").where("a < b").select("a", "b", F.levenshtein("na", "nb").cast("long").alias("d"))


@query("numeric_functions", "SELECT s_suppkey AS id, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, sign(s_acctbal) AS s, round(sqrt(abs(s_acctbal)), 6) AS r, s_suppkey // 7 AS q, s_suppkey % 7 AS m, round(ln(abs(s_acctbal) + 1), 6) AS l FROM supplier")
def numeric_functions(g):
    a = F.col("acctbal")
    return g.nodes["Supplier"].select("id", F.abs(a).alias("a"), F.ceil(a).cast("double").alias("c"), F.floor(a).cast("double").alias("f"), F.signum(a).cast("tinyint").alias("s"), F.round(F.sqrt(F.abs(a)), 6).alias("r"), S.idiv("id", "7").alias("q"), (F.col("id") % 7).alias("m"), F.round(F.ln(F.abs(a) + 1), 6).alias("l"))


@query("trig_functions", "SELECT n_nationkey AS id, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(atan2(n_nationkey, 3), 9) AS t, round(degrees(n_nationkey), 9) AS d FROM nation")
def trig_functions(g):
    k = F.col("id")
    return g.nodes["Nation"].select("id", F.round(F.sin(k), 9).alias("s"), F.round(F.cos(k), 9).alias("c"), F.round(F.atan2(k, F.lit(3)), 9).alias("t"), F.round(F.degrees(k), 9).alias("d"))


@query("temporal_functions", "SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS w, date_diff('day', DATE '1992-01-01', o_orderdate::date) AS days, CAST(date_trunc('quarter', o_orderdate) AS date) AS q FROM orders")
def temporal_functions(g):
    d = F.col("orderdate")
    return g.nodes["Order"].select("id", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofmonth(d).cast("long").alias("d"), (F.weekday(d) + 1).cast("long").alias("w"), F.datediff(d, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.trunc(d, "quarter").alias("q"))


@query("duration_arithmetic", "SELECT o_orderkey AS id, CAST(o_orderdate::date + INTERVAL 1 MONTH + INTERVAL 10 DAY AS date) AS due FROM orders")
def duration_arithmetic(g):
    return g.nodes["Order"].select("id", S.add_duration("orderdate", S.duration(months=1, days=10)).cast("date").alias("due"))


# --- spatial, time series, vectors

COORDS = "((c_custkey * 37) % 170 - 85)::double AS lat, ((c_custkey * 61) % 350 - 175)::double AS lon"


def _places(g):
    return g.nodes["Customer"].select("id", ((F.col("id") * 37) % 170 - 85).cast("double").alias("lat"), ((F.col("id") * 61) % 350 - 175).cast("double").alias("lon"))


@query("near_point", f"SELECT id, round(m, 2) AS metres FROM (SELECT c_custkey AS id, 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2), 1))) AS m FROM (SELECT c_custkey, {COORDS} FROM customer)) WHERE m < 2000000")
def near_point(g):
    m = S.haversine(F.lit(10.0), F.lit(20.0), "lat", "lon")
    return _places(g).select("id", m.alias("m")).where("m < 2000000").select("id", F.round("m", 2).alias("metres"))


@query("bounding_box", f"SELECT id FROM (SELECT c_custkey AS id, {COORDS} FROM customer) WHERE lat BETWEEN -10 AND 30 AND lon BETWEEN 0 AND 90")
def bounding_box(g):
    return _places(g).where(S.within_box("lat", "lon", -10, 0, 30, 90)).select("id")


@query("polygon_contains", f"SELECT id FROM (SELECT c_custkey AS id, {COORDS} FROM customer) WHERE lat > 0 AND lon > 0 AND lat + lon < 60.5")
def polygon_contains(g):
    return _places(g).where(S.point_in_polygon("lat", "lon", [(0.001, 0.001), (60.499, 0.001), (0.001, 60.499)])).select("id")


@query("k_nearest", f"SELECT id FROM (SELECT c_custkey AS id, {COORDS} FROM customer) ORDER BY round(2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat + 5) / 2), 2) + cos(radians(-5.0)) * cos(radians(lat)) * pow(sin(radians(lon - 100) / 2), 2), 1))), 3), id LIMIT 10")
def k_nearest(g):
    return _places(g).orderBy(F.round(S.haversine(F.lit(-5.0), F.lit(100.0), "lat", "lon"), 3), "id").limit(10).select("id")


@query("valid_at", "SELECT o_orderkey AS id FROM orders WHERE (CASE WHEN o_orderstatus = 'F' THEN o_orderdate::date + 30 END IS NULL OR o_orderdate::date + 30 >= DATE '1995-06-01') AND o_orderdate::date <= DATE '1995-06-01'")
def valid_at(g):
    d = F.col("orderdate").cast("date")
    f = g.nodes["Order"].select("id", d.alias("start"), F.when(F.col("orderstatus") == "F", F.date_add(d, 30)).alias("end"))
    return f.where(S.valid_at("start", "end", F.lit("1995-06-01").cast("date"))).select("id")


def _series(g):
    return g.nodes["Event"].select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("channel"), "value")


@query("series_by_day", "SELECT event_type AS channel, CAST(date_trunc('day', ts) AS date) AS day, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def series_by_day(g):
    b = TS.bucket(_series(g).withColumn("id", F.lit(0)), "day")
    return b.select("channel", F.col("bucket").cast("date").alias("day"), "n", F.round("sum", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("series_deltas", "SELECT user_id AS id, event_type AS channel, round(sum(delta), 4) AS moved FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS delta FROM events) GROUP BY 1, 2")
def series_deltas(g):
    return TS.deltas(_series(g)).groupBy("id", "channel").agg(F.round(F.sum("delta"), 4).alias("moved"))


@query("sessions", "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def sessions(g):
    return feed.sessions(g.nodes["Event"]).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


VECTOR = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round({0}, 5) AS score FROM embeddings, q ORDER BY {1}, 1 LIMIT 10"


def _vectors(spark, d, score, descending):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = v.join(F.broadcast(q)).select(F.col("vec_id").alias("id"), F.round(score("embedding", "q"), 5).alias("score"))
    return s.orderBy(F.desc("score") if descending else F.asc("score"), "id").limit(10)


QUERIES["vector_cosine"] = lambda spark, d: _vectors(spark, d, S.cosine, True)
ORACLE["vector_cosine"] = VECTOR.format("list_cosine_similarity(embedding::double[], e::double[])", "2 DESC")
QUERIES["vector_euclidean"] = lambda spark, d: _vectors(spark, d, S.euclidean, False)
ORACLE["vector_euclidean"] = VECTOR.format("list_distance(embedding::double[], e::double[])", "2")
QUERIES["vector_dot"] = lambda spark, d: _vectors(spark, d, S.dot, True)
ORACLE["vector_dot"] = VECTOR.format("list_dot_product(embedding::double[], e::double[])", "2 DESC")


# --- rules


@query("rule_orphan", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rule_orphan(g):
    return R.orphan_node(g.nodes["Customer"], g.all_edges("PLACED"), "out").select("id")


@query("rule_missing_inbound", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def rule_missing_inbound(g):
    return R.missing_inbound_edge(g.nodes["Part"], g.all_edges("CONTAINS").where("quantity > 45")).select("id")


@query("rule_self_loop", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey = l_suppkey")
def rule_self_loop(g):
    lines = g.all_edges("CONTAINS").select("rid", F.col("dst").alias("part")).join(g.all_edges("SUPPLIED_BY").select("rid", "dst"), "rid")
    return R.self_loop(lines.select(F.col("part").alias("src"), "dst"))


LINKS = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 48 AND l_discount > 0.095"


def _nation_links(g):
    rows = g.match("c", "Customer").hop("c", "PLACED", "o", "Order").hop("o", "SUPPLIED_BY", "s", "Supplier", rel="l", rel_where="l_quantity > 48 and l_discount > 0.095")
    return rows.frame.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query("rule_cycle_2step", f"WITH e AS ({LINKS}) SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def rule_cycle_2step(g):
    return R.cycle_2step(_nation_links(g))


@query("rule_inverse_violation", f"WITH e AS ({LINKS}) SELECT src AS a, dst AS b FROM e WHERE (dst, src) NOT IN (SELECT src, dst FROM e)")
def rule_inverse_violation(g):
    e = _nation_links(g)
    return R.inverse_violation(e, e)


@query("rule_transitivity", f"WITH e AS ({LINKS}) SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> x.dst AND x.src <> y.dst AND x.dst <> y.dst AND (x.src, y.dst) NOT IN (SELECT src, dst FROM e)")
def rule_transitivity(g):
    return R.transitivity_violation(_nation_links(g))


@query("rule_duplicate_title", "SELECT p_partkey AS id FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)")
def rule_duplicate_title(g):
    return R.duplicate_property(g.nodes["Part"], "name").select("id")


@query("rule_null_property", "SELECT event_id AS id FROM events WHERE props IS NULL OR props = ''")
def rule_null_property(g):
    return R.null_property(g.nodes["Event"], "props").select("id")


@query("rule_cardinality", "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 3 OR count(o_orderkey) > 20")
def rule_cardinality(g):
    return R.cardinality_violation(g.nodes["Customer"], g.all_edges("PLACED"), 3, 20)


@query("rule_parallel_edges", "SELECT l_orderkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def rule_parallel_edges(g):
    return R.parallel_edges(g.all_edges("SUPPLIED_BY"))


@query("rule_type_domain", "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def rule_type_domain(g):
    return R.endpoint_violation(g.all_edges("CONTAINS"), g.nodes["Order"].where("orderstatus <> 'P'")).select("src", "dst")


# --- algorithms

#: Customers, parts and suppliers, their ids told apart by the remainder of 3, and three links a line: all of the lines.
TRADE = (
    "e AS MATERIALIZED (SELECT 3 * o_custkey AS src, 3 * l_partkey + 1 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 3 * l_partkey + 1, 3 * l_suppkey + 2 FROM lineitem "
    "UNION ALL SELECT 3 * o_custkey, 3 * l_suppkey + 2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey), "
    "v AS MATERIALIZED (SELECT 3 * c_custkey AS id FROM customer UNION ALL SELECT 3 * p_partkey + 1 FROM part UNION ALL SELECT 3 * s_suppkey + 2 FROM supplier), "
    "b AS MATERIALIZED (SELECT src AS u, dst AS w FROM e UNION SELECT dst, src FROM e)"
)


def _trade(g):
    code = lambda c, kind: (F.col(c) * 3 + kind).cast("long")
    rows = g.all_edges("CONTAINS").select(F.col("src").alias("order"), F.col("dst").alias("part"), F.col("suppkey").alias("supplier"))
    rows = rows.join(g.all_edges("PLACED").select(F.col("src").alias("customer"), F.col("dst").alias("order")), "order")
    link = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    c, p, s = code("customer", 0), code("part", 1), code("supplier", 2)
    ends = F.array(link(c, p), link(p, s), link(c, s))
    edges = rows.select(F.explode(ends).alias("e")).select("e.src", "e.dst")
    nodes = [g.nodes[label].select(code("id", k).alias("id")) for k, label in enumerate(("Customer", "Part", "Supplier"))]
    return nodes[0].unionAll(nodes[1]).unionAll(nodes[2]), edges


def _nations(g):
    return g.nodes["Nation"].select("id"), _nation_links(g)


def _rounds(first: str, step: str, rounds: int) -> str:
    """CTEs r0 .. r<rounds>: ``step`` has {0} for the last one's name."""
    parts = [f"r0 AS MATERIALIZED ({first})"] + [f"r{k} AS MATERIALIZED ({step.format(f'r{k - 1}')})" for k in range(1, rounds + 1)]
    return ", ".join(parts) + " "


@query("degree_centrality", f"WITH {TRADE}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT id, round(coalesce(k, 0) / (SELECT count(*) - 1 FROM v), 9) AS score FROM v LEFT JOIN d USING (id)")
def degree_centrality(g):
    return A.degree(*_trade(g)).select("id", F.round("score", 9).alias("score"))


@query("connected_components", f"WITH {TRADE}, " + _rounds("SELECT id, id AS c FROM v", "SELECT id, least(any_value(x.c), coalesce(min(y.c), any_value(x.c))) AS c FROM {0} x LEFT JOIN (SELECT u, c FROM b JOIN {0} ON w = id) y ON u = id GROUP BY id", 8) + "SELECT id, c AS component FROM r8")
def components(g):
    return A.components(*_trade(g))


@query("triangle_count", f"WITH {TRADE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS z FROM e WHERE src <> dst) SELECT count(*) AS triangles FROM u x JOIN u y ON x.z = y.a JOIN u q ON q.a = x.a AND q.z = y.z")
def triangle_count(g):
    return A.triangle_count(_trade(g)[1])


@query("clustering_coefficient", f"WITH {TRADE}, k AS (SELECT u, count(*) AS k FROM b GROUP BY 1), t AS (SELECT x.u, count(*) AS t FROM b x JOIN b y ON x.u = y.u AND x.w < y.w JOIN b q ON q.u = x.w AND q.w = y.w GROUP BY 1) SELECT id, CASE WHEN k >= 2 THEN round(2.0 * coalesce(t, 0) / (k * (k - 1)), 9) ELSE 0 END AS coefficient FROM v LEFT JOIN k ON k.u = id LEFT JOIN t ON t.u = id")
def clustering(g):
    return A.clustering_coefficient(*_trade(g)).select("id", F.round("coefficient", 9).alias("coefficient"))


@query("closeness_centrality", f"WITH RECURSIVE e AS ({LINKS}), w(a, x, h) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT a, e.src, h + 1 FROM w JOIN e ON x = e.dst WHERE h < 6), d AS (SELECT a, x, min(h) AS h FROM w GROUP BY 1, 2) SELECT a AS id, round(CASE WHEN sum(h) > 0 THEN (count(*) - 1.0) / sum(h) * (count(*) - 1.0) / 24 ELSE 0 END, 9) AS score FROM d GROUP BY 1")
def closeness(g):
    return A.closeness(*_nations(g)).select("id", F.round("score", 9).alias("score"))


@query("eccentricity", f"WITH RECURSIVE e AS ({LINKS}), b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e), w(a, x, h) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT a, v, h + 1 FROM w JOIN b ON x = u WHERE h < 6), d AS (SELECT a, x, min(h) AS h FROM w GROUP BY 1, 2) SELECT a AS id, max(h) AS eccentricity FROM d GROUP BY 1")
def eccentricity(g):
    return A.eccentricity(*_nations(g))


@query("ready_set", "SELECT e.event_id AS id, (n.b IS NOT NULL)::bigint AS dependency_count FROM events e JOIN (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) n ON n.a = e.event_id LEFT JOIN events d ON d.event_id = n.b WHERE e.event_type <> 'click' AND (n.b IS NULL OR d.event_type = 'click')")
def ready_set(g):
    return A.ready_set(g.nodes["Event"].select("id"), g.all_edges("NEXT"), g.nodes["Event"].where("event_type = 'click'").select("id"))


@query(
    "pagerank",
    f"WITH {TRADE}, n AS (SELECT count(*)::double AS n FROM v), k AS (SELECT src, count(*)::double AS k FROM e GROUP BY 1), l AS MATERIALIZED (SELECT e.src, e.dst, count(*) / any_value(k) AS w FROM e JOIN k USING (src) GROUP BY 1, 2), "
    + _rounds("SELECT id, 1 / n AS s FROM v, n", "SELECT id, (0.15 + 0.85 * coalesce((SELECT sum(s) FROM {0} WHERE id NOT IN (SELECT src FROM k)), 0)) / n + 0.85 * coalesce(got, 0) AS s FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(s * w) AS got FROM {0} JOIN l ON src = id GROUP BY 1) ON dst = id", 10)
    + "SELECT id, round(s, 9) AS score FROM r10",
)
def pagerank(g):
    return A.pagerank(*_trade(g), iterations=10).select("id", F.round("score", 9).alias("score"))


@query(
    "k_core",
    f"WITH {TRADE}, "
    + _rounds("SELECT u AS id, count(*) AS c FROM b GROUP BY 1", "SELECT id, max(least(value, h)) AS c FROM (SELECT id, value, sum(k) OVER (PARTITION BY id ORDER BY value DESC) AS h FROM (SELECT x.id, least(x.c, y.c) AS value, count(*) AS k FROM {0} x JOIN b ON u = x.id JOIN {0} y ON w = y.id GROUP BY 1, 2)) GROUP BY 1", 30)
    + "SELECT v.id, coalesce(c, 0)::bigint AS coreness FROM v LEFT JOIN r30 USING (id)",
)
def k_core(g):
    return A.k_core(*_trade(g))


@query(
    "label_propagation",
    f"WITH {TRADE}, "
    + _rounds("SELECT id, id AS c FROM v", "SELECT x.id, coalesce(best, x.c) AS c FROM {0} x LEFT JOIN (SELECT u, arg_min(c, (-n, c)) AS best FROM (SELECT u, c, count(*) AS n FROM b JOIN {0} ON w = id GROUP BY 1, 2) GROUP BY 1) ON u = x.id", 4)
    + "SELECT id, c AS community FROM r4",
)
def label_propagation(g):
    return A.label_propagation(*_trade(g), iterations=4)


# --- writes, change feed, selections, ingestion


@query("merge_upsert", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN s_acctbal + 100 ELSE s_acctbal END AS acctbal FROM supplier UNION ALL SELECT 1000000, 5.0")
def merge_upsert(g):
    s = g.nodes["Supplier"].select("id", "acctbal")
    new = s.where("id % 10 = 0").select("id", F.lit(100.0).alias("acctbal")).unionAll(g.spark.range(1).select(F.lit(1_000_000).cast("long"), F.lit(5.0)))
    return io.merge_nodes(s, new, "sum")


@query("detach_delete", "SELECT count(*) AS n FROM orders WHERE o_custkey % 3 <> 0")
def detach_delete(g):
    gone = g.nodes["Customer"].where("id % 3 = 0").select(F.col("id").alias("src"))
    return g.all_edges("PLACED").join(gone, "src", "left_anti").agg(F.count("*").alias("n"))


@query("change_feed", "SELECT operation, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 5 = 1 THEN 'delete' WHEN s_suppkey % 7 = 0 THEN 'update' END AS operation FROM supplier WHERE s_suppkey % 5 = 1 OR s_suppkey % 7 = 0 UNION ALL SELECT 'create') GROUP BY 1")
def change_feed(g):
    s = g.nodes["Supplier"].select("id", "name", "acctbal")
    after = s.where("id % 5 <> 1").withColumn("acctbal", F.when(F.col("id") % 7 == 0, F.col("acctbal") + 1).otherwise(F.col("acctbal")))
    after = after.unionAll(g.spark.range(1).select(F.lit(-1).cast("long"), F.lit("new"), F.lit(0.0)))
    return feed.counts_by_operation(feed.changes(s, after, 1))


@query("select_where_any", "SELECT c_custkey AS id FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) OR c_nationkey IN (1, 2)")
def select_where_any(g):
    return Selection.of(g, "Customer").where_any({"mktsegment": "BUILDING", "acctbal": {">": 5000}}, {"nationkey": [1, 2]}).frame.select("id")


@query("select_traverse", "SELECT DISTINCT r_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 9000")
def select_traverse(g):
    return Selection.of(g, "Supplier").where(acctbal={">": 9000}).traverse("IN_NATION", "Nation").traverse("IN_REGION", "Region").frame.select("name")


@query("select_statistics", "SELECT c_mktsegment AS mktsegment, count(c_acctbal) AS n, round(sum(c_acctbal), 2) AS total, round(stddev_samp(c_acctbal), 5) AS sd FROM customer GROUP BY 1")
def select_statistics(g):
    return Selection.of(g, "Customer").statistics("acctbal", per="mktsegment").select("mktsegment", "n", F.round("sum", 2).alias("total"), F.round("std", 5).alias("sd"))


@query("select_group_limit", "SELECT p_partkey AS id FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def select_group_limit(g):
    return Selection.of(g, "Part").top(3, "retailprice", per="brand").frame.select("id")


@query("select_set_operations", "SELECT c_custkey AS id FROM customer WHERE (c_acctbal > 5000) <> (c_nationkey < 10)")
def select_set_operations(g):
    c = Selection.of(g, "Customer")
    return c.where(acctbal={">": 5000}).symmetric_difference(c.where(nationkey={"<": 10})).frame.select("id")


@query("select_calculate", "SELECT p_partkey AS id, round(p_retailprice * p_size, 4) AS worth FROM part WHERE p_size >= 40")
def select_calculate(g):
    return Selection.of(g, "Part").where(size={">=": 40}).calculate("worth", "round(retailprice * size, 4)").frame.select("id", "worth")


@query("graph_statistics", "SELECT 'Customer' AS source, 'PLACED' AS kind, 'Order' AS target, count(*) AS n FROM orders UNION ALL SELECT 'Order', 'CONTAINS', 'Part', count(*) FROM lineitem UNION ALL SELECT 'Nation', 'IN_REGION', 'Region', count(*) FROM nation")
def graph_statistics(g):
    return g.stats().where("kind in ('PLACED', 'CONTAINS', 'IN_REGION')")


# --- paths, clusters and computed elements

STEPS = f"WITH RECURSIVE e AS ({LINKS} AND l_quantity > 49), "


def _sparse_links(g):
    rows = g.match("c", "Customer").hop("c", "PLACED", "o", "Order").hop("o", "SUPPLIED_BY", "s", "Supplier", rel="l", rel_where="l_quantity > 49 and l_discount > 0.095")
    return rows.frame.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def _levels() -> str:
    """Breadth first from every nation, level by level: l0 .. l6."""
    parts = ["l0 AS MATERIALIZED (SELECT n_nationkey AS source, n_nationkey AS id, 0 AS hops, 1::hugeint AS paths FROM nation)"]
    for k in range(1, 7):
        seen = " UNION ALL ".join(f"SELECT source, id FROM l{j}" for j in range(k))
        parts.append(f"l{k} AS MATERIALIZED (SELECT source, dst AS id, {k} AS hops, sum(paths) AS paths FROM l{k - 1} JOIN e ON src = id WHERE (source, dst) NOT IN ({seen}) GROUP BY 1, 2)")
    return ", ".join(parts)


@query("all_shortest_path_counts", f"WITH e AS MATERIALIZED ({LINKS}), {_levels()} SELECT source, id, hops, paths::bigint AS paths FROM ({' UNION ALL '.join(f'SELECT * FROM l{k}' for k in range(7))})")
def all_shortest_path_counts(g):
    return P.shortest_path_counts(g.nodes["Nation"].select("id"), _nation_links(g))


@query(
    "weighted_distances",
    f"WITH e AS MATERIALIZED ({LINKS}), "
    + _rounds("SELECT n_nationkey AS a, n_nationkey AS x, 0.0::double AS d FROM nation", "SELECT a, x, min(d) AS d FROM (SELECT * FROM {0} UNION ALL SELECT a, dst, d + 1 + (src * 7 + dst * 3) % 5 FROM {0} JOIN e ON src = x) GROUP BY 1, 2", 12)
    + "SELECT a AS source, x AS id, d AS distance FROM r12",
)
def weighted_distances(g):
    e = _nation_links(g).withColumn("cost", 1 + (F.col("src") * 7 + F.col("dst") * 3) % 5)
    return P.weighted_distances(g.nodes["Nation"].select("id"), e, "cost")


@query("expand_two_hops", STEPS + "b AS (SELECT src AS u, dst AS v FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), w(x, h) AS (SELECT 3, 0 UNION SELECT v, h + 1 FROM w JOIN b ON x = u WHERE h < 2) SELECT DISTINCT x AS id FROM w")
def expand_two_hops(g):
    return P.expand(g.nodes["Nation"].where("id = 3"), _sparse_links(g), 2)


@query("induced_subgraph", STEPS + "dummy AS (SELECT 1) SELECT src, dst FROM e WHERE src < 12 AND dst < 12")
def induced_subgraph(g):
    return P.induced(_sparse_links(g), g.nodes["Nation"].where("id < 12")).select("src", "dst")


@query("betweenness_centrality", None)
def betweenness_centrality(g):
    return P.betweenness(g.nodes["Nation"].select("id"), _sparse_links(g)).select("id", F.round("score", 9).alias("score"))


@query("spatial_join", f"WITH p AS (SELECT c_custkey AS id, {COORDS} FROM customer), a AS (SELECT n_nationkey AS id, (n_nationkey * 13 % 120 - 60) + 0.5 AS lat, (n_nationkey * 29 % 300 - 150) + 0.5 AS lon FROM nation) SELECT p.id AS point, a.id AS area FROM p JOIN a ON p.lat BETWEEN a.lat - 6 AND a.lat + 6 AND p.lon BETWEEN a.lon - 9 AND a.lon + 9")
def spatial_join(g):
    at = lambda y, x: F.struct((F.col("id") * 13 % 120 - 60 + 0.5 + y).cast("double").alias("lat"), (F.col("id") * 29 % 300 - 150 + 0.5 + x).cast("double").alias("lon"))
    areas = g.nodes["Nation"].select("id", F.array(at(-6, -9), at(-6, 9), at(6, 9), at(6, -9)).alias("ring"))
    return SP.points_in_areas(_places(g), areas, cell=5.0)


@query("dbscan", f"WITH RECURSIVE p AS (SELECT c_custkey AS id, {COORDS} FROM customer), n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) <= 64), c AS (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) >= 2), l AS (SELECT a, b FROM n WHERE a IN (FROM c) AND b IN (FROM c)), r(a, x) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.x = l.a), k AS (SELECT a AS id, min(x) AS cluster FROM r GROUP BY 1), e AS (SELECT n.b AS id, min(cluster) AS border FROM n JOIN k ON n.a = k.id GROUP BY 1) SELECT p.id, coalesce(cluster, border, -1) AS cluster FROM p LEFT JOIN k ON k.id = p.id LEFT JOIN e ON e.id = p.id")
def dbscan(g):
    return SP.dbscan(_places(g).select("id", F.col("lat").alias("x"), F.col("lon").alias("y")), 8.0, 2)


@query("compute_chain", "SELECT count(*) AS n, count(DISTINCT b) AS targets FROM (SELECT lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL")
def compute_chain(g):
    return C.chain(g, "Order", "THEN", "custkey", ["orderdate"]).all_edges("THEN").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


@query("compute_calendar", "WITH d AS (SELECT min(o_orderdate)::date AS a, max(o_orderdate)::date AS b FROM orders), r AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::date AS x FROM d) SELECT strftime(x, '%Y-%m') AS month, count(*) AS days, sum((SELECT count(*) FROM orders WHERE o_orderdate::date = x))::bigint AS orders FROM r GROUP BY 1")
def compute_calendar(g):
    C.calendar(g, "Order", "orderdate")
    n = g.all_edges("ON_DATE").groupBy(F.col("dst").alias("day")).agg(F.count("*").alias("n"))
    days = g.all_edges("IN_MONTH").join(n, F.col("src") == F.col("day"), "left")
    return days.groupBy(F.col("dst").alias("month")).agg(F.count("*").alias("days"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"))


@query("compute_aggregate", "SELECT c_nationkey AS nationkey, c_mktsegment AS mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY 1, 2")
def compute_aggregate(g):
    C.aggregate(g, "Customer", "Group", ["nationkey", "mktsegment"], {"n": "count(*)", "total": "round(sum(acctbal), 2)", "poorest": "min_by(id, struct(acctbal, id))"}, "MEMBER_OF")
    return g.nodes["Group"].drop("id")


@query("compute_derive_filter", "SELECT p_partkey AS id, round(p_retailprice / p_size, 4) AS per_unit FROM part WHERE p_retailprice / p_size < 40")
def compute_derive_filter(g):
    C.keep(C.derive(g, "Part", {"ratio": "retailprice / size", "per_unit": "round(ratio, 4)"}), "Part", "ratio < 40", "Cheap")
    return g.nodes["Cheap"].select("id", "per_unit")


@query("property_statistics", "SELECT count(p_brand) AS value_count, count(*) - count(p_brand) AS null_count, count(DISTINCT p_brand) AS distinct_count, count(p_brand) = count(DISTINCT p_brand) AS is_unique FROM part")
def property_statistics(g):
    return C.property_stats(g.nodes["Part"], "brand")


@query("poly_label_neighbours", "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def poly_label_neighbours(g):
    rows = g.match("n", "Nation").count("n", "IN_NATION", "Customer", "customers", direction="in").count("n", "IN_NATION", "Supplier", "suppliers", direction="in")
    return rows.frame.select(F.col("n_name").alias("nation"), "customers", "suppliers")


@query("louvain_communities", None)
def louvain_communities(g):
    return communities.louvain(*_trade(g))
