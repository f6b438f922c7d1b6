import random
import re

import pytest

from latticework.llm import ngram_join
from latticework.llm.ngram_join import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=4, percent=85):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(50)]
    rows, base = [], [rng.choice(vocab) for _ in range(120)]
    for i in range(60):  # one chain of ever farther variants and one ball around a base
        if i % 2:
            base = base[:]
            base[rng.randrange(120)] = "c%d" % i
            words = base
        else:
            words = base[:]
            for _ in range(rng.choice([1, 2, 4, 6])):
                words[rng.randrange(120)] = "v%d" % rng.randrange(50)
        rows.append(words)
    for i in range(60):
        rows.append([rng.choice(vocab) for _ in range(rng.choice([1, 3, 10, 60]))] + passage * rng.choice([0, 1]))
    rows += [rows[3]] * 5 + [["Same", "WORDS"], ["same", "words"], ["É"], ["é"]]
    rng.shuffle(rows)
    out = [(i * 3 + 1, " ".join(w)) for i, w in enumerate(rows)]
    return out + [(5000, None), (5001, ""), (5002, " \t\n"), (out[0][0], "other text of a repeated id here"), (5003, "long text " * 20000), (5004, "Long\ttext " * 19990)]


@pytest.mark.parametrize("seed,rounds,block", [(1, 3, 256), (2, 1, 7), (3, 2, 3)])
def test_same_as_brute_force(spark, monkeypatch, seed, rounds, block):
    monkeypatch.setattr(ngram_join, "FEW", seed)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = near_duplicates(df, rounds=rounds, block=block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f"), (4, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(one).collect()) == [("4", 1, "4"), ("None", 3, "None")]


def test_a_large_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """3,000 texts that differ from one in a word or two: the rows that meet in blocks stay far below the pairs."""
    rng = random.Random(2)
    first = [f"w{k}" for k in range(260)]
    rows = []
    for i in range(3000):
        words = list(first)
        for _ in range(rng.choice([1, 2])):
            words[rng.randrange(260)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    met = []
    join = ngram_join._join_blocks
    monkeypatch.setattr(ngram_join, "_join_blocks", lambda blocks, percent: (met.append(blocks.count()), join(blocks, percent))[1])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 3000
    assert sum(met) <= 20 * 3000


def test_percent_is_checked(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=2)
