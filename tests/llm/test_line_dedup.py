import duckdb

from latticework.llm import oracle
from latticework.llm.line_dedup import drop_lines

LONG = "the server at node {} answered after a long while with the code {} and then went on to serve other requests"
ROWS = [
    (1, "unique first line of one\nAll rights reserved.\n" + LONG.format("alpha7", 200)),
    (2, "unique second text here\nAll rights reserved.\n" + LONG.format("beta9", 404) + "\n"),
    (3, "All rights reserved."),
    (4, "a b\nsolo words only in this document of four"),
    (5, "a b\n" + LONG.format("x1", 1).replace("other requests", "every request")),
    (6, LONG.format("x1", 1).replace("server", "client").replace("other", "many")),
    (7, None),
    (8, ""),
    (9, "inside repeat line one\ninside repeat line one"),
    (10, "\t All  rights\treserved. \n\n tail stays here only"),
    (11, "word " * 30000 + "\nAll rights reserved."),
    (3, "All rights reserved.\nother row of the same id"),
    (None, "All rights reserved."),
]


def test_templates_and_edges(spark):
    df = spark.createDataFrame([(*r, "x", 5) for r in ROWS], "doc_id long, text string, pos string, gone int")
    out = drop_lines(df)
    assert out.columns == ["doc_id", "text", "pos", "gone", "n_lines", "n_dropped"]
    got = {(r.doc_id, r.n_lines): r for r in out.collect()}
    assert got[1, 3].text == ROWS[0][1] and got[1, 3].n_dropped == 0
    assert got[2, 4].text == "unique second text here\n" and got[2, 4].n_dropped == 2
    assert got[3, 1].text == "" and got[3, 2].text == "other row of the same id"
    assert got[5, 2].text == "a b" and got[6, 1].n_dropped == 0
    assert got[7, 0].text is None and got[8, 1].text == "" and got[9, 2].n_dropped == 0
    assert got[10, 3].text == "\n tail stays here only" and got[11, 2].n_dropped == 1
    assert got[None, 1].text == "All rights reserved."
    assert drop_lines(df.limit(0)).count() == 0


def test_same_as_sql(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT doc_id, n_lines, n_dropped, text FROM ({oracle.LINE_TEMPLATES})").fetchall()
    got = [tuple(r) for r in drop_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def short_lines():
    """Twelve documents with short lines of templates, nine with others, too few to count."""
    names = "Anna Bert Carl Dora Emil Fay Gus Hal Ina Jan Kim Lou".split()
    rows = []
    for k, name in enumerate(names):
        text = [f"By {name} in Sports today", "Read more", f"Share {name} with others", f"only line of {name} here that goes on for long enough to be no template of any kind {name}"]
        rows.append((k, "\n".join(text + (["Read less", f"Posted by {name}s editor team"] if k < 9 else []))))
    return rows


def test_short_lines_need_support(spark):
    df = spark.createDataFrame(short_lines(), "doc_id long, text string")
    got = {r.doc_id: r for r in drop_lines(df).collect()}
    assert got[0].n_dropped == 0
    assert all(got[k].n_dropped == 3 and ("Read less" in got[k].text) == (k < 9) for k in range(1, 12))
    assert {r.n_dropped for r in drop_lines(df, support=13).collect()} == {0}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(f"SELECT doc_id, n_lines, n_dropped, text FROM ({oracle.LINE_TEMPLATES})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in got.values())
