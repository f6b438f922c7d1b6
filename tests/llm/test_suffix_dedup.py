import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from latticework.llm.suffix_array import equal_prefixes, suffix_array
from latticework.llm.suffix_dedup import remove_repeats


@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(values):
    assert suffix_array(np.array(values, np.int64)).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def test_adjacent_prefixes():
    s = np.array([1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 4, 7])
    order = np.array([0, 4, 8])
    assert equal_prefixes(s, order, 3).tolist() == [True, False]


def brute(rows, length=200):
    count = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((str(doc), len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passage, base = words(60), words(300)
    rows = [(i, words(rng.randint(1, 80)) + (" " + passage[rng.randint(0, 20) :] + " " if i % 3 == 0 else "") + words(20)) for i in range(60)]
    for i in range(25):  # near copies: a word is changed here and there
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(5)
        rows.append((100 + i, " ".join(w)))
    rows += [(200, base), (200, base), (201, None), (202, ""), (203, "short"), (204, "ab" * 400), (205, "a" * 199), (206, "a" * 200), (207, "ba" * 150 + "tail"), (None, base[:230]), (208, passage[:200]), (209, words(9000) + passage), (200, "another text of the id " + passage)]
    return rows


@pytest.mark.parametrize("seed,most", [(1, 2000), (2, 3)])
def test_same_as_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, most=most).collect())
    assert got == brute(rows)


def test_empty_and_text(spark):
    df = spark.createDataFrame([(1, "é" * 150 + "x"), (2, "y" + "é" * 150)], "doc_id long, text string")
    assert {bytes(r.kept) for r in remove_repeats(df, keep_text=True).collect()} == {b"x", b"y"}
    assert remove_repeats(df.limit(0)).count() == 0
