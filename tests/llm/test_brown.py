import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from latticework.llm import brown
from latticework.llm.brown import Emissions, ending, exchange, score_documents, transitions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low) + [" "]


def corpus():
    rng = random.Random(3)
    groups = [["der", "die", "das"], ["hund", "baum", "weg"], ["the", "a"], ["dog", "tree", "road"]]
    rows = []
    for i in range(80):
        first, second = (0, 1) if i % 2 else (2, 3)
        rows.append((i, " ".join(rng.choice(groups[first]) + " " + rng.choice(groups[second]) + rng.choice(["", ".", str(rng.randrange(9))]) for _ in range(20))))
    return rows + [(90, None), (91, ""), (92, "É é X\x0by"), (93, "unseen words only"), (None, "the dog"), (0, "a second row"), (94, "tree " * 30000)]


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


def brute_scores(rows, held, frequent, endings, classes):
    """The whole model word by word: seed classes by ``exchange``, one step for each other word, counts, probabilities."""
    train = [tokens(t) for (_, t), h in zip(rows, held) if not h]
    count = Counter(w for ws in train for w in ws)
    order = sorted(count, key=lambda w: (-count[w], w.encode()))
    of = lambda w: ending(w.encode())
    ends = Counter()
    for w, c in count.items():
        ends[of(w)] += c
    ends = sorted(ends, key=lambda e: (-ends[e], e))[:endings]
    own = order[:frequent]

    def unit(w):
        return own.index(w) if w in own else len(own) + (ends.index(of(w)) if of(w) in ends else len(ends))

    units = len(own) + len(ends) + 1
    m = np.zeros((units, units), np.float32)
    for ws in train:
        for a, b in zip(ws[-1:] + ws[:-1], ws):
            m[unit(a), unit(b)] += 1
    member = exchange(m, classes)
    seed = lambda w: int(member[unit(w)])
    big = np.zeros((classes, classes))
    for ws in train:
        for a, b in zip(ws[-1:] + ws[:-1], ws):
            big[seed(a), seed(b)] += 1
    final = {}
    for w in count:
        final[w] = seed(w)
        if w in own or count[w] < 2:
            continue
        out, into = Counter(), Counter()
        for ws in train:
            for i, x in enumerate(ws):
                if x == w:
                    out[seed(ws[(i + 1) % len(ws)])] += 1
                    into[seed(ws[i - 1])] += 1
        n, k0, gains = count[w], seed(w), []
        for k in range(classes):
            total = 0.0
            for side, get, whole in ((out, lambda c: big[k, c], big[k].sum()), (into, lambda c: big[c, k], big[:, k].sum())):
                more = 0 if k == k0 else 1
                total += sum(xlogx(get(c) + more * x) - xlogx(get(c) - (1 - more) * x) for c, x in side.items())
                total -= xlogx(whole + more * n) - xlogx(whole - (1 - more) * n)
            gains.append(total)
        best = max(range(classes), key=lambda k: gains[k])
        if gains[best] > gains[k0] + 1e-3:
            final[w] = best
    big = np.zeros((classes, classes))
    for ws in train:
        for a, b in zip(ws[-1:] + ws[:-1], ws):
            big[final[a], final[b]] += 1
    share = [(big[:, b].sum() + 1) / (big.sum() + classes) for b in range(classes)]
    scores = []
    for _, text in rows:
        ws, total = tokens(text), 0.0
        cls = [final.get(w, seed(w)) for w in ws]
        for a, b, w in zip(cls[-1:] + cls[:-1], cls, ws):
            kinds = max(sum(x > 0 for x in big[a]), 1)
            total += math.log10((big[a, b] + kinds * share[b]) / (big[a].sum() + kinds))
            here = [x for x in count if final[x] == b]
            size = sum(count[x] for x in here)
            once, twice = (sum(count[x] == j for x in here) for j in (1, 2))
            d = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95) if here else 0.5
            if count[w]:
                total += math.log10((count[w] - d) / size)
            elif here:
                total += math.log10(d * len(here) / size)
        scores.append(total)
    return scores


@pytest.mark.parametrize("sent", [1000, 30])
def test_scores(spark, sent):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = score_documents(df, frequent=3, endings=4, classes=4, broadcast_words=sent).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    n, v = sum(count.values()), len(count)
    want = []
    for (i, text), h in zip(rows, held):
        w = tokens(text)
        want.append((str(i), h, len(w), sum(count[t] > 0 for t in w), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w), 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    brute = brute_scores(rows, held, 3, 4, 4)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 2)) for r in got) == sorted((str(i), len(tokens(t)), round(x, 2)) for (i, t), x in zip(rows, brute))


def test_exchange_finds_the_classes_and_sums_to_one():
    rng = np.random.default_rng(0)
    kind = np.arange(12) % 3
    seq = []
    for _ in range(4000):
        seq.append(rng.choice(np.flatnonzero(kind == (len(seq) % 3))))
    m = np.zeros((12, 12))
    np.add.at(m, (seq[:-1], seq[1:]), 1)
    member = exchange(m, 3)
    assert len({tuple(sorted(np.flatnonzero(member == k))) for k in range(3)} & {tuple(np.flatnonzero(kind == k)) for k in range(3)}) == 3
    assert np.allclose((10 ** transitions(m)).sum(1), 1)
    model = Emissions(3, {0: (4, 1000, 2, 1)})
    counts = np.array([600, 398, 1, 1])
    assert math.isclose(((counts - model.discount[0]) / 1000).sum() + 10 ** model.unknown[0], 1)


def test_endings_and_empty(spark):
    assert [ending(x.encode()) for x in ("nation.", "a1", "é,", "x")] == ["on .".encode(), b"#", "é ,".encode(), b"x "]
    assert score_documents(spark.createDataFrame([], "doc_id long, text string"), classes=2).count() == 0


def test_texts_are_cut_into_words_twice_and_contexts_shuffled_once(spark, monkeypatch):
    """To count words and to number them; words seen once are in no context."""
    plans, put = [], brown.Scratch.put
    monkeypatch.setattr(brown.Scratch, "put", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(self, df))[1])
    rows = [(i, "the dog and a cat once%d sat" % i) for i in range(8)]
    assert score_documents(spark.createDataFrame(rows, "doc_id long, text string"), frequent=2, endings=2, classes=2).count() == 8
    assert sum("text#" in p for p in plans) == 2
    contexts = [p for p in plans if "contexts#" in p]
    assert len(contexts) == 1 and contexts[0].count("Exchange ") == 1


def test_contexts_against_brute_force(spark):
    """Words sent along and others, of texts in one batch: classes before and after, texts being rings."""
    texts = ["a b a c", "", "c d", "a d d x"]
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1)
    lex = brown.Lexicon([b" ", b"a", b"b"], np.array([4, 3, 1]), 1, [b"a "]).ready()
    member, want, count = np.array([0, 1, 2]), Counter(), Counter()
    unit = lambda w: 0 if w == " " else 1 if w == "a" else 2
    for t in texts:
        ws = tokens(t)
        count.update(ws)
        for i, w in enumerate(ws):
            want[w, unit(ws[i - 1]) * 3 + unit(ws[(i + 1) % len(ws)])] += w != " "
    lexicon = spark.sparkContext.broadcast(lex)
    got = brown.count_contexts(brown.encode_texts(docs, lexicon), lexicon, member, 3).collect()
    found = {(lex.words[r["at"]].decode() if r["at"] >= 0 else r["word"].decode(), c % 9): c // 9 for r in got for c in r["contexts"]}
    assert found == {k: n for k, n in want.items() if n and count[k[0]] >= 2}


class Taken:
    """Stands for a frame; gives the function that its rows would go through."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


class Sent:
    def __init__(self, value):
        self.value = value


def context_rows(rng, words, contexts, classes):
    """Joint contexts (n, class before, class after) of each word, all different."""
    codes = [rng.choice(classes * classes, contexts, replace=False) for _ in range(words)]
    return [[int(n) * classes * classes + int(c) for n, c in zip(rng.integers(1, 9, contexts), cs)] for cs in codes]


def test_memory_of_best_classes_is_bounded(spark):
    """Words with a thousand contexts each, as frequent words of large tables have: 260 MB an array before they were cut."""
    rng, classes, words = np.random.default_rng(1), 64, 500
    lex = brown.Lexicon([b" "], np.array([1]), 1, []).ready()
    rows = context_rows(rng, words, 1000, classes)
    batch = pa.RecordBatch.from_arrays([pa.array([-1] * words, pa.int32()), pa.array([b"w%d" % i for i in range(words)]), pa.array(rows)], names=["at", "word", "contexts"])
    run = brown.best_classes(Taken(), Sent(lex), np.array([0, 0]), rng.random((classes, classes)) * 1000)
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_best_classes_against_brute_force(spark, monkeypatch):
    """Contexts that share a class on one side count together; rows of a word may lie in several batches."""
    rng, classes, words = np.random.default_rng(2), 5, 60
    lex = brown.Lexicon([b" "], np.array([1]), 1, []).ready()
    seed, member, rows = np.floor(rng.random((classes, classes)) * 40) + 150, np.array([0, 3]), context_rows(rng, words, 12, classes)
    df = spark.createDataFrame([(-1, b"w%d" % i, r) for i, r in enumerate(rows)], "at int, word binary, contexts array<long>").coalesce(1)
    monkeypatch.setattr(brown, "CHUNK", 5, raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {bytes(r["word"]): r["cls"] for r in brown.best_classes(df, spark.sparkContext.broadcast(lex), member, seed).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for i, row in enumerate(rows):
        out, into, gains = Counter(), Counter(), []
        for x in row:
            into[x % classes**2 // classes] += x // classes**2
            out[x % classes] += x // classes**2
        n = sum(out.values())
        for k in range(classes):
            more, total = int(k != 3), 0.0
            for sums, get, whole in ((out, lambda c: seed[k, c], seed[k].sum()), (into, lambda c: seed[c, k], seed[:, k].sum())):
                total += sum(xlogx(get(c) + more * x) - xlogx(get(c) - (1 - more) * x) for c, x in sums.items())
                total -= xlogx(whole + more * n) - xlogx(whole - (1 - more) * n)
            gains.append(total)
        if max(gains) > gains[3] + 1e-3:
            want[b"w%d" % i] = gains.index(max(gains))
    assert got == want and len(set(want.values())) > 1


def test_words_and_contexts_in_small_pieces(spark, monkeypatch):
    """Odd white space, nulls and letters beyond ASCII; pieces of a few bytes and rows of two contexts add up to the same."""
    texts = ["  a b\t\x0bA\x1cc ", None, "", " \n", "c É d", "a d d x\r", "b b b a b c a d a b", "A c d a"]
    words, at, ends = brown.words_of(pa.array(texts))
    cut = [[words[i].as_py().decode() for i in at[a:z]] for a, z in zip([0, *ends.tolist()], ends.tolist())]
    assert cut == [tokens(t) for t in texts]
    for name, size in (("TEXT", 8), ("PIECE", 16), ("GATHER", 2), ("CHUNK", 2), ("FLUSH", 3)):
        monkeypatch.setattr(brown, name, size)
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1)
    count = Counter(w for t in texts for w in tokens(t))
    assert {bytes(r["word"]).decode(): r["c"] for r in brown.count_words(docs).collect()} == count
    lex = brown.Lexicon([b" ", b"a", b"b"], np.array([8, 7, 6]), 1, [b"a "]).ready()
    unit = lambda w: 0 if w == " " else 1 if w == "a" else 2
    lexicon, want, found = spark.sparkContext.broadcast(lex), Counter(), Counter()
    for t in texts:
        ws = tokens(t)
        for i, w in enumerate(ws):
            if w != " " and count[w] >= 2:
                want[w, unit(ws[i - 1]) * 3 + unit(ws[(i + 1) % len(ws)])] += 1
    rows = brown.count_contexts(brown.encode_texts(docs, lexicon), lexicon, np.array([0, 1, 2]), 3).collect()
    for r in rows:
        for c in r["contexts"]:
            found[lex.words[r["at"]].decode() if r["at"] >= 0 else bytes(r["word"]).decode(), c % 9] += c // 9
    assert found == want and max(len(r["contexts"]) for r in rows) <= 2
