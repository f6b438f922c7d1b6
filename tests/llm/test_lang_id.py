import pyspark.sql.functions as F

from latticework.llm.lang_id import identify, predict

WORDS = {
    "en": "the of and that house water thing with which through thought".split(),
    "de": "der und nicht schule zwischen haus wasser mit durch gedacht auch".split(),
    "fr": "le de et que maison eau chose avec lequel pensée où être".split(),
    "es": "el los que casa agua cosa con cual pensado año también niño".split(),
    "xx": "qaq zuz wow kakak vuvu pipip".split(),
}


def texts(n):
    for lang, words in WORDS.items():
        for i in range(n):
            yield lang, " ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] for j in range(25))


def test_held_out_accuracy_and_edges(spark):
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate(texts(30))]
    rows += [(900, None, "en", "s"), (901, "", None, "s"), (902, "123 !!", "en", "s"), (903, "the house of thought " * 20000, None, "s"), (None, "the house of the water", None, "s"), (0, rows[0][1], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len([r for r in got if r.doc_id == 0]) == 4  # two rows joined with two
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is None or r.doc_id == 903:
            assert r.lang_pred == "en"
        else:
            assert r.lang_pred == r.lang
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in identify(docs).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert identify(docs.limit(0)).count() == 0
    assert predict(docs, None).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    one = spark.createDataFrame([(i, "some words", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(one).collect()} == {"en"}
    assert identify(one.withColumn("lang", F.lit(None).cast("string"))).count() == 20
