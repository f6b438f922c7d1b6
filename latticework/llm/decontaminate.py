"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers (in digits or English words), names, quantities (5kg) and units after a number
turn into typed placeholders, all else is lower-cased and stripped of edge punctuation. Names are capitalised words, those with inner capitals included (NASA,
McDonald), unless more than ``RUN`` follow each other, as in a headline. A text is read twice. In the first reading
each word is a token and a capitalised word that starts a sentence is an ordinary one; in the second it is a name, and
a run of capitalised words that no punctuation divides is one name, so that names at sentence starts and names of
another length in words meet too. Five-token template windows of the documents are hash-joined with those of the
benchmark in the same reading; a window counts as found if it is in either. Windows that line up (same document, item and shift) are
accepted if their slots are consistent: each value in the item always meets the same value in the document and the
other way round, so a question with other numbers or names in it is still caught and a chance fit is not. An item
counts as leaked where at least ``coverage`` (0.8) of its windows are found. A window of placeholders alone, as in a table,
says nothing by its template and meets the same values only. An item under five words is one window, which meets
whole lines.

Only windows whose hash the benchmark has are emitted from Python. Up to ``broadcast_windows`` benchmark windows and
``broadcast_bytes`` of them the hashes travel as a broadcast array; beyond it all windows go through a shuffled join. Results are
the same.

Defined cases: null or empty texts have no window and match nothing; an item
whose second reading has fewer than five tokens counts windows of the first alone; repeated items each match; texts are read whole; rows with a null id are returned as clean, since nothing names them; rows that
repeat an id are judged together; extra columns are ignored; empty tables give empty results or no match.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import encode, mix
from latticework.storage import Scratch

W = 5
#: Unit words that are placeholders after a number.
UNITS = frozenset(
    b"% kg g mg lb lbs oz t km m cm mm mi miles mile ft feet foot in inch inches yd l ml kb mb gb tb s sec second seconds "
    b"min minute minutes h hour hours day days week weeks month months year years mph kmh km/h usd eur gbp dollar dollars "
    b"euro euros cent cents percent degrees degree celsius fahrenheit watt watts kw kwh volt volts hz khz mhz ghz".split()
)
#: Numbers in words.
NUMBER_WORDS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    b"twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
NUMBER = re.compile(rb"[+-]?[$\xc2\xa3\xe2\x82\xac]*\d[\d.,:/-]*(?:st|nd|rd|th|%)?")
QUANTITY = re.compile(rb"[+-]?\d[\d.,]*([^\d.,]+)")
EDGES = b".,;:!?\"'()[]{}<>"
OTHER, NUM, NAME, UNIT, CAPS, AMOUNT = 0, 1, 2, 3, 4, 5
CACHE = 400_000
#: Longer runs of capitalised words are no name.
RUN = 6
#: Words that are handled at once.
CHUNK = 100_000
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(RUN)], np.uint64)


class Canon:
    """Codes of words, kept while a task runs: value hash, kind, whether it ends a sentence, whether it ends a run of names."""

    def __init__(self):
        self._clear()

    def _clear(self):
        self.code: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, bool, bool]] = []
        self.np = None

    def _new(self, word: bytes) -> int:
        core = word.strip(EDGES) or word
        text = core.decode("utf-8", "replace")
        low = text.lower().encode()
        if NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            kind = NUM
        elif (amount := QUANTITY.fullmatch(low)) and amount[1] in UNITS:
            kind = AMOUNT
        elif low in UNITS:
            kind = UNIT
        elif low != core and core[1:].decode("utf-8", "ignore").islower():
            kind = NAME
        elif len(text) > 1 and any(map(str.isupper, text)):
            kind = CAPS
        else:
            kind = OTHER
        ends = word.rstrip(b"\"')]").endswith((b".", b"!", b"?", b":"))
        self.rows.append((xxhash.xxh3_64_intdigest(low), kind, ends, word[-1:] in EDGES))
        self.code[word] = n = len(self.rows) - 1
        return n

    def __call__(self, words: list[bytes], first: np.ndarray) -> tuple:
        """Two readings of texts whose first words are ``first``: (template hashes, values, kinds, word where each token starts)."""
        if len(self.code) > CACHE:
            self._clear()
        get, new = self.code.get, self._new
        ids = np.fromiter([c if (c := get(w)) is not None else new(w) for w in words], np.int64, len(words))
        if self.np is None or len(self.np[0]) < len(self.rows):
            h, k, e, c = zip(*self.rows[len(self.np[0]) if self.np else 0 :])
            fresh = (np.array(h, np.uint64), np.array(k, np.int8), np.array(e, bool), np.array(c, bool))
            self.np = fresh if self.np is None else tuple(np.concatenate(x) for x in zip(self.np, fresh))
        value, kind, ends, closes = (x[ids] for x in self.np)
        starts, after, joins = np.zeros(len(ids), bool), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        capital = (kind == NAME) | (kind == CAPS)
        starts[1:], after[1:], joins[1:] = ends[:-1], kind[:-1] == NUM, capital[:-1] & ~closes[:-1]
        starts[first], after[first], joins[first] = True, False, False
        kind = np.where((kind == UNIT) & ~after, OTHER, kind)
        run = np.cumsum(capital & ~joins)
        named = capital & (np.bincount(run[capital], minlength=run[-1] + 1)[run] <= RUN)
        plain = np.where(kind == CAPS, np.where(named, NAME, OTHER), kind)
        plain = np.where((plain == NAME) & starts, OTHER, plain)
        at = np.flatnonzero(~(named & joins))
        folded = np.where(named, NAME, np.where(capital, OTHER, kind))[at]
        away = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
        whole = np.add.reduceat(value * POWERS[away], at)
        readings = (value, plain, np.arange(len(ids))), (whole, folded, at)
        return tuple((np.where(k == OTHER, v, k.astype(np.uint64)), v, k, p) for v, k, p in readings)


def windows_of(template: np.ndarray, value: np.ndarray, kind: np.ndarray, width: int = W) -> np.ndarray:
    """Hashes of all windows: of their templates, or of their values where all tokens are placeholders."""
    n = max(len(template) - width + 1, 0)
    out, exact, plain = np.full(n, width, np.uint64), np.full(n, width, np.uint64), np.zeros(n, bool)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + template[j : j + n])
        exact = mix(exact * np.uint64(0x9E3779B97F4A7C15) + value[j : j + n])
        plain |= kind[j : j + n] == OTHER
    return np.where(plain, out, exact)


def slots_of(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of the placeholders among some tokens: offset + 8 * kind and value, flattened."""
    spots = np.flatnonzero(kind)
    flat = np.empty(2 * len(spots), np.int64)
    flat[::2] = spots + 8 * kind[spots].astype(np.int64)
    flat[1::2] = value[spots].view(np.int64)
    return flat


def _scan(text_column: str, id_column: str, known: np.ndarray | None, lines: bool):
    """Rows (id, reading, pos, place, wh, slots) of windows; with ``known`` (sorted hashes) only of those in it.

    pos: the first token in its own reading, or the number of a short line; place: that token in the second reading, or
    the word where the second has no window. ``lines``: each line of fewer than five words is a window too; otherwise
    each such text.
    """

    def scan(batches):
        canon = Canon()
        seen = None
        if known is not None:
            seen = np.zeros(1 << 20, bool)
            seen[known & np.uint64((1 << 20) - 1)] = True

        def rows(ids, words, sizes):
            first = np.cumsum([0, *sizes[:-1]])
            readings = canon(words, first)
            folds = readings[1][3]
            lead = np.searchsorted(folds, first)  # the first folded token of each text
            last = np.append(lead[1:], len(folds)) - lead - W
            for reading, (template, value, kind, begin) in enumerate(readings):
                h = windows_of(template, value, kind) ^ np.uint64(reading)
                if known is None:
                    at = np.arange(len(h))
                else:
                    at = np.flatnonzero(seen[h & np.uint64((1 << 20) - 1)])
                    if len(at):
                        k = np.searchsorted(known, h[at])
                        at = at[known[np.minimum(k, len(known) - 1)] == h[at]]
                text = np.searchsorted(first, begin[at], "right") - 1
                same = text == np.searchsorted(first, begin[at + W - 1], "right") - 1
                at, text = at[same], text[same]
                if not len(at):
                    continue
                word = begin[at] - first[text]
                place = np.searchsorted(folds, begin[at], "right") - 1 - lead[text]
                place = np.where(last[text] < 0, word, np.minimum(place, last[text]))
                slots = [slots_of(kind[p : p + W], value[p : p + W]) for p in at.tolist()]
                pos = at - lead[text] if reading else word
                yield pd.DataFrame({"id": pd.Series([ids[t] for t in text.tolist()], dtype="Int64"), "reading": reading, "pos": pos, "place": place, "wh": h[at].view(np.int64), "slots": slots})

        def short_rows(found):
            """Whole short lines ``(id, line number, words)``, in both readings."""
            first = np.cumsum([0, *[len(words) for _, _, words in found[:-1]]])
            readings = canon([w for _, _, words in found for w in words], first)
            out = []
            for reading, (template, value, kind, begin) in enumerate(readings):
                edges = np.append(np.searchsorted(begin, first), len(begin))
                for (i, line, _), a, z in zip(found, edges, edges[1:]):
                    h = windows_of(template[a:z], value[a:z], kind[a:z], z - a)[0] ^ np.uint64(2 + reading)
                    if known is None or (len(known) and known[min(np.searchsorted(known, h), len(known) - 1)] == h):
                        out.append((i, reading, line, 0, int(h.view(np.int64)), slots_of(kind[a:z], value[a:z])))
            out = pd.DataFrame(out, columns=["id", "reading", "pos", "place", "wh", "slots"])
            return out.assign(id=out["id"].astype("Int64"))

        ids, words, sizes = [], [], []
        for pdf in batches:
            short = []
            for i, text in zip(pdf[id_column], pdf[text_column]):
                text = encode(text)
                more = text.split()
                if lines:
                    short += [(i, n, w) for n, line in enumerate(text.split(b"\n")) if 0 < len(w := line.split()) < W]
                elif 0 < len(more) < W:
                    short.append((i, 0, more))
                if len(more) < W:
                    continue
                ids.append(i)
                words += more
                sizes.append(len(more))
                if len(words) > CHUNK:
                    yield from rows(ids, words, sizes)
                    ids, words, sizes = [], [], []
            if short:
                yield short_rows(short)
        if ids:
            yield from rows(ids, words, sizes)

    return scan


WINDOWS = "id long, reading long, pos long, place long, wh long, slots array<long>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, broadcast_windows: int = 2_000_000, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """``(doc_id, item_id, item_windows, found_windows, coverage, reparameterised)`` of leaked items."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = scratch.put(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .mapInPandas(_scan("text", "item_id", None, False), WINDOWS)
        .selectExpr("id as item_id", "reading as item_reading", "pos as item_pos", "place as item_place", "wh", "slots as item_slots")
    )
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(64 + 8 * F.size("item_slots")), F.lit(0)).alias("bytes")).first()
    short = not benchmark.where(F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")) < W).isEmpty()
    known, items_side = None, items.drop("item_reading")
    if size["n"] <= broadcast_windows and size["bytes"] <= broadcast_bytes:
        known = np.unique(items.select("wh").distinct().toArrow()["wh"].to_numpy().view(np.uint64))
        items_side = F.broadcast(items_side)
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInPandas(_scan("text", "doc_id", known, short), WINDOWS)
        .drop("place")
        .withColumnRenamed("id", "doc_id")
    )
    lined = found.join(items_side, "wh").withColumn("shift", F.col("pos") - F.col("item_pos"))
    met = lined.select(
        "doc_id",
        "item_id",
        "reading",
        "shift",
        "item_place",
        # element pairs (spot, spot), (value, value), ...: keep the values, with the kind of the spot; words in lower case meet
        # the same words as names by value, and then one side has no slots
        F.expr(
            "transform(filter(sequence(0, size(slots)), i -> i % 2 = 1 and i < least(size(slots), size(item_slots))), "
            "i -> struct(shiftright(slots[i - 1], 3) as kind, item_slots[i] as a, slots[i] as b))"
        ).alias("met"),
    )
    runs = met.groupBy("doc_id", "item_id", "reading", "shift").agg(
        F.collect_set("item_place").alias("at"), F.array_distinct(F.flatten(F.collect_set("met"))).alias("met")
    )
    count = "size(array_distinct(transform(met, x -> struct(x.kind, x.{0}))))"
    fit = runs.where(f"{count.format('a')} = size(met) and {count.format('b')} = size(met)")
    leaks = fit.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("found_windows"),
        F.max(F.expr("exists(met, x -> x.a <> x.b)")).alias("reparameterised"),
    )
    totals = items.groupBy("item_id").agg(F.countDistinct("item_place").alias("item_windows"))
    return (
        leaks.join(F.broadcast(totals) if known is not None else totals, "item_id")
        .withColumn("coverage", F.col("found_windows") / F.col("item_windows"))
        .where(F.col("coverage") >= coverage)
        .select("doc_id", "item_id", "item_windows", "found_windows", "coverage", "reparameterised")
    )


def judge_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row per document: ``(doc_id, contaminated, n_items, items, coverage, reparameterised)``."""
    leaks = find_leaks(docs, benchmark, **options)
    per_doc = leaks.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.max("coverage").alias("coverage"),
        F.max("reparameterised").alias("reparameterised"),
    )
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        .join(per_doc, "doc_id", "left")
        .select(
            "doc_id",
            F.col("items").isNotNull().alias("contaminated"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<long>")).alias("items"),
            F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
            F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
        )
    )
