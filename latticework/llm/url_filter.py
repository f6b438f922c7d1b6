"""URL filter with redirect equivalence (native: DataFrame operations only).

Pages whose url no rule covers inherit the decision of the urls they are aliases of: canonical links and
meta-refresh redirects in the html, and rows of an optional ``redirects`` table, are the edges of a graph over
normalised urls (scheme and fragment removed), and each connected component shares its decisions. Precedence,
highest first: the page's own longest rule; an explicit allow anywhere in the component; a block anywhere in the
component; allow.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, no aliases and the verdict
allow. Null html has no links. Repeated urls share one node. Other columns of ``pages`` are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import ascii_lower
from latticework.operators.components import connected_components
from latticework.storage import Scratch

#: (decision, host/path). A configuration list, not data: it becomes one CASE expression.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def host_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _fits(host: Column, path: Column, rule: str) -> Column:
    at = rule.index("/")
    name, start = rule[:at], rule[at:]
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


def own_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its decision; null where none does. At equal length an allow wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in reversed(ordered):
        rule = F.when(_fits(host, path, text), text).otherwise(rule)
        verdict = F.when(_fits(host, path, text), kind).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    """Normalised url: lower-case host, path without a last slash, query; no scheme, no fragment. Null without ://."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), r"(?s)#.*$", "")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(tail, r"/(?=\?|$)", "")))


def absolute(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base``."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    site = F.regexp_extract(base, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(F.instr(href, "://") > 0, href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when((href == "") | href.startswith("#"), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, href))
    )


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.trim(F.regexp_replace(found, "^[\"']|[\"']$", ""))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(u, v)`` of normalised urls that are declared the same."""
    linked = pages.where(
        (F.instr("url", "://") > 0) & F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b")
    ).select("url", "html")
    tags = linked.select(
        "url",
        F.explode(
            F.concat(
                F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), 0), lambda t: _attribute(t, "href")),
                F.transform(
                    F.regexp_extract_all("html", F.lit(REFRESH), 0),
                    lambda t: F.regexp_extract(_attribute(t, "content"), r"(?i)\burl\s*=\s*['\"]?([^'\"\s]+)", 1),
                ),
            )
        ).alias("href"),
    )
    edges = tags.select(node_of(F.col("url")).alias("u"), node_of(absolute(F.col("url"), F.col("href"))).alias("v"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")))
    return edges.where("u is not null and v is not null and u <> v")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` to ``(page_id, host, path, rule, verdict, inherited)``."""
    pages = pages.select("page_id", "url", "html")
    url = F.col("url")
    rule, verdict = own_rule(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("rule", rule)
        .withColumn("own", verdict)
        .withColumn("node", node_of(url))
    )
    scratch = Scratch(pages.sparkSession)
    member = connected_components(alias_edges(pages, redirects), scratch)
    # rules judge every url of a component, also those that no page has
    site = F.regexp_extract("node", r"^[^/?]*", 0)
    path = F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
    _, by_url = own_rule(site, F.when(path == "", "/").otherwise(F.concat(path, F.lit("/"))), rules)
    votes = member.select("root", by_url.alias("own")).unionByName(
        judged.where("own is not null").join(member, "node").select("root", "own")
    )
    shared = votes.groupBy("root").agg(
        F.when(F.max((F.col("own") == "allow").cast("int")) == 1, "allow")
        .when(F.max((F.col("own") == "block").cast("int")) == 1, "block")
        .alias("inherited")
    )
    decided = member.join(shared, "root").select("node", "inherited")
    return judged.join(decided, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNull(), F.col("inherited")).alias("inherited"),
    )
