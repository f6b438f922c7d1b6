import random
import re
from collections import defaultdict

import pytest

from latticework.llm.decontaminate import NUMBER_WORDS, UNITS, find_leaks, judge_documents

ITEM = "A train leaves Paris with 120 people and 45 of them leave at Lyon so how many of the 120 people are still there"
ITEMS = [(1, ITEM), (2, "too short item"), (3, None), (4, ""), (5, "In winter all of the small birds of Oslo fly 300 km to the south coast and back")]
DOCS = {
    1: "intro words. " + ITEM + ". outro words",
    2: "Some text. " + ITEM.replace("120", "77").replace("45", "12").replace("Paris", "Madrid").replace("Lyon", "Toledo"),
    3: "Some text. " + ITEM.replace("of the 120", "of the 99"),  # the same value meets two values
    4: "Nothing of this kind is here at all, only plain words that go on for a while.",
    5: None,
    6: "",
    7: " ".join(ITEM.split()[:12]),
    8: "filler " * 20000 + ITEM,
    9: "So. In winter all of the small birds of Bergen fly 450 miles to the south coast and back. " + ITEM,
}


@pytest.mark.parametrize("bound", [1000, 0])
def test_leaks(spark, bound):
    docs = spark.createDataFrame([(k, v, "x") for k, v in DOCS.items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in judge_documents(docs, items, broadcast_windows=bound).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {1, 2, 8, 9}
    assert [got[k].reparameterised for k in (1, 2, 8, 9)] == [False, True, False, True]
    assert got[9]["items"] == [1, 5] and got[4]["items"] == [] and got[5].coverage == 0.0


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, DOCS[1]), (1, DOCS[1]), (None, DOCS[1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1] * 2, "item_id long, text string")
    none = items.limit(0)
    assert find_leaks(docs, none).count() == 0
    assert find_leaks(docs.limit(0), items).count() == 0
    got = judge_documents(docs, items).collect()
    assert sorted(r.contaminated for r in got) == [False, True, True]


NAMED = "Natalia sold 48 clips in April to friends. Natalia then sold half as many clips in May. How many clips did she sell in all of Paris with her friends?"
ACRONYM = "The people of NASA asked McDonald how far 12 probes went past Mars and O'Brien said they went twice as far"


@pytest.mark.parametrize("bound", [1000, 0])
def test_names_at_starts_of_other_length_and_inner_capitals(spark, bound):
    other = NAMED.replace("Natalia", "Maria")
    texts = {
        1: NAMED,
        2: "Intro here. " + other,
        3: "Intro here. " + other.replace("Paris", "New York"),
        4: "so " + NAMED.replace("Natalia", "Anna Lena").replace("How many", "how many"),
        5: NAMED.replace("Natalia sold", "Maria sold").replace("Natalia then", "Peter then").replace("Paris", "Maria"),  # one name meets two
        6: "Well. " + ACRONYM.replace("NASA", "ESA").replace("McDonald", "Smith").replace("O'Brien", "MacArthur"),
        7: "A LONG LINE OF CAPITALS THAT IS NOT A NAME AT ALL BUT A HEADLINE SET IN CAPITALS OF A PAPER FROM LONG AGO",
        8: " ".join(f"Word{chr(97 + k)}" for k in range(20)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, NAMED), (2, ACRONYM), (3, "THE TRAIN FROM PARIS LEFT WITH SIXTY PEOPLE ON BOARD AND SOME OF THEM WERE ASLEEP"), (4, "Anna Bell Met Carl Dunn")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.coverage, r.reparameterised) for r in judge_documents(docs, items, broadcast_windows=bound).collect()}
    assert got[1] == ([1], 1.0, False)
    assert [got[k][0] for k in (2, 3, 4, 6)] == [[1], [1], [1], [2]]
    assert got[2][1:] == (1.0, True) and got[3][1:] == (1.0, True)
    assert [1 in got[k][0] for k in (5, 7, 8)] == [False] * 3 and got[7][0] == []


def test_texts_do_not_run_into_each_other(spark):
    half = ITEM.split()
    docs = spark.createDataFrame([(k, " ".join(half[k * 6 : k * 6 + 6])) for k in range(4)] + [(9, ITEM)], "doc_id long, text string").coalesce(1)
    got = find_leaks(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string")).collect()
    assert [(r.doc_id, r.coverage, r.item_windows) for r in got] == [(9, 1.0, len(half) - 4)]


PAIRS = [
    ("Alice bought 3 apples and gave away 2", "Bob bought 5 apples and gave away 4", True),
    ("A rope of 5kg is pulled by a boat of 7kg today", "A rope of 6kg is pulled by a boat of 9kg today", True),
    ("There are three boats and each boat holds five people inside", "There are seven boats and each boat holds nine people inside", True),
    ("The probe was built by NASA for the long trip to Mars", "The probe was built by ESA for the long trip to Venus", True),
    ("How tall is Everest?", "Some words here before it.\nHow tall is Kilimanjaro?\nAnd some after.", True),
    ("How old is Everest?", "They asked us how old is Everest? in the middle of a line", False),  # short items meet whole lines
    ("Paris", "Some long line of words stands here.\nLondon\nend", False),  # a name alone is no template
    ("10 20 30 40 50 60", "7 8 9 10 11 12 13", False),  # nor are numbers alone
    ("11 21 31 41 51 61", "a table 11 21 31 41 51 61 of it", True),
]


@pytest.mark.parametrize("bound", [1000, 0])
def test_reparameterised_pairs(spark, bound):
    items = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(PAIRS)], "item_id long, text string")
    docs = spark.createDataFrame([(k, b) for k, (_, b, _) in enumerate(PAIRS)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items, broadcast_windows=bound).collect()}
    assert got == {(k, k) for k, (_, _, same) in enumerate(PAIRS) if same}


NUMBER = re.compile(r"[+-]?[$£€]*\d[\d.,:/-]*(?:st|nd|rd|th|%)?")
EDGES = ".,;:!?\"'()[]{}<>"


def readings(text):
    """Two lists of ``(kind, value, word number)``."""
    words, plain, folded, run = text.split(), [], [], []
    cores = [w.strip(EDGES) or w for w in words]

    def kind_of(i):
        core, low = cores[i], cores[i].lower()
        if NUMBER.fullmatch(core) or low.encode() in NUMBER_WORDS:
            return "num"
        amount = re.fullmatch(r"[+-]?\d[\d.,]*([^\d.,]+)", low)
        if amount and amount[1].encode() in UNITS:
            return "amount"
        if low.encode() in UNITS:
            return "unit"
        if core != low and core[1:].islower():
            return "name"
        return "caps" if len(core) > 1 and core != low else None

    kinds = [kind_of(i) for i in range(len(words))]
    kinds = [None if k == "unit" and (i == 0 or kinds[i - 1] != "num") else k for i, k in enumerate(kinds)]
    capital = [k in ("name", "caps") for k in kinds]
    runs = []
    for i, c in enumerate(capital):
        if c and i and capital[i - 1] and words[i - 1][-1] not in EDGES:
            runs[-1].append(i)
        elif c:
            runs.append([i])
    named = {i for r in runs if len(r) <= 6 for i in r}
    for i, k in enumerate(kinds):
        starts = i == 0 or words[i - 1].rstrip("\"')]").endswith((".", "!", "?", ":"))
        if k == "caps":
            k = "name" if i in named else None
        plain.append((None if k == "name" and starts else k, (cores[i].lower(),), i))
    for i, k in enumerate(kinds):
        head = next((r for r in runs if i in r), None)
        if i in named and head[0] != i:
            continue
        value = tuple(cores[j].lower() for j in head) if i in named else (cores[i].lower(),)
        folded.append(("name" if i in named else None if capital[i] else k, value, i))
    return plain, folded


def brute_leaks(docs, items, coverage=0.8):
    """Every document against every item, window by window."""

    def windows(text, lines):
        """``(reading, template) -> [(pos, place, slots)]``"""
        out, both = defaultdict(list), readings(text)
        long = len(text.split()) >= 5
        begin = [p for _, _, p in both[1]]
        for reading, tokens in enumerate(both):
            for at in range(len(tokens) - 4):
                part = tokens[at : at + 5]
                word = part[0][2]
                place = word if len(begin) < 5 else min(sum(b <= word for b in begin) - 1, len(begin) - 5)
                out[reading, template(part)].append((at if reading else word, place, slots(part)))
        for n, line in enumerate(text.split("\n") if lines else [] if long else [text]):
            if 0 < len(line.split()) < 5:
                for reading, part in enumerate(readings(line)):
                    out[reading + 2, template(part)].append((n, 0, slots(part)))
        return out

    def template(part):
        plain = any(k is None for k, _, _ in part)
        return tuple((k,) if k and plain else v for k, v, _ in part)

    def slots(part):
        return [(k, v) for k, v, _ in part if k]

    found = set()
    for i, item in items:
        mine = windows(item or "", False)
        places = {p for rows in mine.values() for _, p, _ in rows}
        for d, doc in docs:
            met, at = defaultdict(set), defaultdict(set)
            for (reading, t), rows in windows(doc or "", True).items():
                for pos, _, there in rows:
                    for item_pos, place, here in mine.get((reading, t), []):
                        key = reading % 2, pos - item_pos
                        at[key].add(place)
                        met[key] |= {(k, a, b) for (k, a), (_, b) in zip(here, there)}
            hit = set()
            for key, m in met.items():
                if len({(k, a) for k, a, _ in m}) == len(m) == len({(k, b) for k, _, b in m}):
                    hit |= at[key]
            if places and len(hit) >= coverage * len(places):
                found.add((d, i, len(places), len(hit)))
    return found


@pytest.mark.parametrize("bound", [10_000, 0])
def test_against_brute_force(spark, bound):
    rng = random.Random(11)
    names, plain = ["Anna", "Bob", "NASA", "McAdam", "Oslo", "New York", "Rio"], "the boat runs to a hill and some of them see it".split()

    def word():
        return rng.choice([rng.choice(plain), rng.choice(plain), rng.choice(names), str(rng.randrange(40)), "5 km", rng.choice(["three", "Seven"]), f"{rng.randrange(9)}kg", rng.choice(plain) + "."])

    items = [(k, " ".join(word() for _ in range(rng.choice([2, 4, 6, 9, 14])))) for k in range(25)] + [(25, None), (26, "")]
    docs = []
    for k in range(60):
        text = items[rng.randrange(25)][1]
        if rng.random() < 0.7:
            old, new = rng.choice(names), rng.choice(names)
            text = text.replace(old, new).replace(str(rng.randrange(40)), str(rng.randrange(40)))
        sep = rng.choice([" ", "\n", ". "])
        docs.append((k, " ".join(word() for _ in range(rng.randrange(8))) + sep + text + sep + " ".join(word() for _ in range(rng.randrange(8)))))
    docs += [(100, None), (101, "")]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=bound).collect()
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id, r.item_windows, r.found_windows) for r in got} == want and len(want) > 20


def test_words_of_an_item_as_names(spark):
    item = "please note the quick brown fox jumps over a lazy dog"
    texts = ["foo bar said The Quick Brown Fox Jumps over a lazy dog and ran", "we said please note The Quick Brown Fox Jumps over a lazy dog", item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind in ({}, {"broadcast_windows": 0}):
        got = find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.1, **kind)
        assert {r.doc_id: r.found_windows for r in got.collect()} == {0: 1, 1: 1, 2: 7}
