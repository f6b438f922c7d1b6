import random
import re

import pytest

import corpus_pipeline

pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = {
    "en": "the of and that house water thing with which through thought there their".split(),
    "fr": "le de et que maison eau chose avec lequel pensée où être après".split(),
}


def fixture():
    rng = random.Random(5)

    def line(lang, n):
        return " ".join(rng.choice(VOCAB[lang]) + rng.choice("abcdefgh") for _ in range(n))

    items = [(k, line("en", 40)) for k in range(5)]
    boiler = line("en", 12)
    docs = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = [line(lang, 30) for _ in range(3)]
        if i % 5 == 0:
            text.insert(1, boiler)
        if i % 7 == 0:
            text.append(line(lang, 10) + " " + items[i % 5][1] + " " + line(lang, 10))
        docs.append((i, "\n".join(text), lang))
    docs += [(100, docs[1][1], "en"), (101, docs[2][1].replace("\n", " "), "en"), (102, None, None), (103, "12 34 !!", None), (104, boiler, "en"), (105, "", "fr")]
    near = docs[4][1].replace("\n", " ").split()
    near[50] = "changed"
    docs.append((106, " ".join(near), "en"))
    return docs, items


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = {i: t for i, t, _ in docs if t and any(map(str.isalpha, t))}
    first = {}
    for i in sorted(now):
        for x in now[i].split("\n"):
            first.setdefault(x, i)
    now = {i: "\n".join(x for x in t.split("\n") if first[x] == i or len(WORD.findall(x)) < 3) for i, t in now.items()}
    now = {i: t for i, t in now.items() if t}
    sets = {i: shingles(t) for i, t in now.items()}
    gone = {j for i in now for j in now if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    now = {i: t for i, t in now.items() if i not in gone}
    now = {i: t for i, t in now.items() if not any(len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x)) for _, x in items)}

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == columns
    got = {r.doc_id: r for r in df.collect()}
    assert {i: r.text for i, r in got.items()} == now
    assert all(r.n_chars == len(r.text) for r in got.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(now)
    assert 100 not in now and 101 not in now and 106 not in now and 104 not in now and len(now) > 40


def test_stages_on_edge_cases(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(1, None, None, None, None), (None, "a text of a null id here", None, None, None), (2, "", "en", "s", 0), (3, "some words of it", None, "s", 5), (3, "some words of it", None, "s", 5), (3, "other words of the id", None, "s", 5)]
    for rows in (odd, []):
        df = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert df.columns == [c.split()[0] for c in schema.split(", ")]
        # the repeated row goes, the null id and the other text of the id stay
        assert sorted(str(r.doc_id) for r in df.collect()) == (["3", "3", "None"] if rows else [])
