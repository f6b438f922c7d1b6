import duckdb

from latticework.llm import oracle
from latticework.llm.url_filter import filter_urls

LINK = '<html><head><link href="{}" rel="canonical"></head></html>'
PAGES = [
    (1, "https://a.example.com/de/x", None),
    (2, "https://m.other.io/p?id=1#top", LINK.format("https://a.example.com/de/x")),
    (3, "http://alias.io/q", '<META content="0; URL=//m.other.io/p?id=1" http-equiv=refresh>'),
    (4, "http://www.example.net/en/ok", LINK.format("http://mix.io/")),
    (5, "http://bad.net/z", LINK.format("http://mix.io")),
    (6, "http://mix.io/", ""),
    (7, None, LINK.format("http://bad.net/z")),
    (8, "no scheme", LINK.format("x")),
    (9, "HTTP://X.EXAMPLE.ORG/fr/a?b", LINK.format("/fr/c")),
    (10, "http://x.example.org/fr/c", LINK.format("")),
    (11, "http://bad.net", LINK.format("rel/page")),
    (12, "http://deep.io/a/b/c.html", LINK.format("d.html")),
    (13, "http://deep.io/a/b/d.html", LINK.format("http://sub.bad.net/1")),
    (13, "http://deep.io/a/b/d.html", LINK.format("http://sub.bad.net/1")),
]


def test_aliases_and_precedence(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert got[1] == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[4][3] == "allow" and got[5][3] == "block" and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("x.example.org", "/fr/a", "org/fr/", "allow")
    assert got[11][:3] == ("bad.net", "", None)
    assert got[12][3] == "block" and got[13][3] == "block"


def test_same_as_sql(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    con = duckdb.connect()
    pages = df.toPandas()
    con.register("pages", pages)
    want = sorted(map(str, con.sql(f"SELECT page_id, host, path, rule, verdict, inherited FROM ({oracle.URL_FILTER})").fetchall()))
    assert sorted(str(tuple(r)) for r in filter_urls(df).collect()) == want


def test_redirect_table_and_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert filter_urls(none).count() == 0
    df = spark.createDataFrame([(1, "http://q.io/", None)], "page_id long, url string, html string")
    hops = spark.createDataFrame([(f"http://h{i}.io", f"http://h{i + 1}.io") for i in range(6)] + [("http://q.io", "http://h0.io"), ("http://h6.io", "http://t.net/x"), (None, "http://h1.io")], "from_url string, to_url string")
    assert filter_urls(df, redirects=hops).first().verdict == "block"
