"""Removal of repeated byte strings with suffix arrays, exact, over whole texts.

A byte goes if it is in a string of ``length`` (200) bytes that starts anywhere else too. A suffix array over a whole
corpus costs many times its size, so only the suffixes that a repeat can start at are sorted:

1. Every window of ``length`` bytes has an anchor, its 64-byte string of least hash. Starts with one anchor make a run;
   a run's span is the bytes of its windows. Equal windows have equal anchors, so only runs of anchors that occur
   twice matter. Runs of equal anchor and equal span are one class, and classes of two runs or more repeat as a whole.
2. In anchors with several classes, single runs are open: some of their windows may be in another class. The windows
   are dealt into cells by their place relative to the anchor, each with all the bytes that its windows share as its
   name. Cells whose name no other class has are done; equal cells repeat as a whole.
3. The spans that are still open are gathered by name, and their suffixes sorted by the difference-cover algorithm
   (``suffix_array``): sampled triples are sorted and named, names are sorted recursively, the other suffixes merged;
   neighbours with ``length`` equal bytes are repeats. Groups of over ``most`` cells are not sorted in one task: their
   windows are named one by one and counted, which spreads them over the cluster.

Hashes are two of 64 bits together. Defined cases: null text is empty; texts shorter than ``length`` keep everything; rows that
repeat an id are separate occurrences, and so are equal rows; null ids are returned; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import encode
from latticework.llm.suffix_array import equal_prefixes, suffix_array
from latticework.storage import Scratch

ANCHOR = 64
#: The bitmap that spares the second pass most rows of other anchors has 16 bits an anchor, within these powers of two.
#: Where it is full, more rows are shuffled; the result is the same.
BITMAP_BITS = (20, 29)
#: Bytes that are sorted at once.
BATCH = 1_000_000
CELLS = 4


class Runs:
    """Anchored runs of a text."""

    def __init__(self, length: int):
        self.length, self.width = length, length - ANCHOR + 1
        self.powers = np.ones(1, np.uint64)
        rng = np.random.default_rng(12345)
        self.table = [rng.integers(1, 1 << 63, 256, np.uint64) for _ in range(2)]
        self.base = np.uint64(0x9E3779B97F4A7C15)

    def _prefix_sums(self, b: np.ndarray, which: int) -> np.ndarray:
        n = len(b)
        if len(self.powers) < n:
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, self.base, np.uint64))])
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[which][b] * self.powers[:n], out=out[1:])
        return out

    def __call__(self, text: bytes):
        """``(order hash of anchor, anchor name, span name, start, starts, anchor - start)``, or None if too short.

        Names are polynomial hashes of randomly mapped bytes, made independent of place by division by the power of the first.
        """
        n = len(text)
        if n < self.length:
            return None
        b = np.frombuffer(text, np.uint8)
        h = b.astype(np.uint32) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        step = 1
        while step < ANCHOR:
            later = h[step:]
            h = h[: len(later)] * np.uint32(0x85EBCA6B) + (later ^ (later >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
            step *= 2
        key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        w, windows = self.width, n - self.length + 1
        blocks = np.concatenate([key, np.full(-len(key) % w, ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).ravel()[w - 1 : w - 1 + windows]
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()[:windows]
        at = (np.minimum(ahead, behind) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        starts = np.diff(np.append(start, windows))
        anchor = at[start]
        sums = self._prefix_sums(b, 0), self._prefix_sums(b, 1)
        lowered = self._inverse(n)
        name = (sums[0][anchor + ANCHOR] - sums[0][anchor]) * lowered[anchor]
        end = start + starts + self.length - 1
        span = (sums[1][end] - sums[1][start]) * lowered[start] + (anchor - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return h[anchor], name, span, start, starts, anchor - start

    def _inverse(self, n: int) -> np.ndarray:
        """base ** -i modulo 2 ** 64."""
        if not hasattr(self, "inverses") or len(self.inverses) < n:
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, inverse, np.uint64))])
        return self.inverses


def _hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """``(anchor, small, a, b, c)``: least and greatest class and count of each anchor that occurs."""

    def run(batches):
        runs = Runs(length)
        for pdf in batches:
            found = [r[:3] for r in (runs(encode(t)) for t in pdf["text"]) if r is not None]
            if found:
                small, name, span = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"anchor": name.view(np.int64), "small": small.astype(np.int64), "cls": span.view(np.int64)})

    rows = docs.select("text").mapInPandas(run, "anchor long, small long, cls long")
    grouped = rows.groupBy("anchor").agg(F.first("small").alias("small"), F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("c"))
    return grouped.where("c > 1")


def _bitmap(anchors: DataFrame, bits: int) -> np.ndarray:
    """Bits of the anchors' order hashes, put together in words by the cluster: a fixed number of words at most."""
    place = F.col("small").bitwiseAND(F.lit((1 << bits) - 1))
    words = anchors.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, int(small & {(1 << bits) - 1} & 63))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def _members(docs: DataFrame, length: int, wanted: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """Runs of wanted anchors. ``span`` is there for the first run of a class in a batch, if its anchor is mixed."""

    def hit(bitmap, small):
        v = small.astype(np.int64) & (64 * len(bitmap) - 1)
        return (bitmap[v >> 6] >> (v & 63).astype(np.uint64)) & np.uint64(1) == 1

    def run(batches):
        runs = Runs(length)
        for pdf in batches:
            parts, spans, ids, texts, seen = [], [], [], [], set()
            for i, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"]):
                text = encode(text)
                found = runs(text)
                if found is None:
                    continue
                keep = hit(wanted, found[0])
                if not keep.any():
                    continue
                small, name, span, start, starts, off = (x[keep] for x in found)
                parts.append((name.view(np.int64), span.view(np.int64), start, starts, off))
                ids += [i] * len(name)
                texts += [row] * len(name)
                mixed_here = hit(mixed, small)
                for k in range(len(name)):
                    pair = (int(name[k]), int(span[k]))
                    if mixed_here[k] and pair not in seen:
                        seen.add(pair)
                        spans.append(text[start[k] : start[k] + starts[k] + length - 1])
                    else:
                        spans.append(None)
            if parts:
                name, span, start, starts, off = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "row": texts, "anchor": name, "cls": span, "start": start, "starts": starts, "off": off, "span": spans})

    schema = "doc_id long, row long, anchor long, cls long, start long, starts long, off long, span binary"
    return docs.mapInPandas(run, schema)


def _cells(classes: DataFrame, length: int, cells: int) -> DataFrame:
    """``(anchor, cls, cell, first, last, name, part, c)``: windows dealt by their place relative to the anchor.

    first, last: the cell's starts within the span; name: of all bytes that the cell's windows share; part: of all
    bytes of the class's windows in the cell.
    """
    width = length - ANCHOR + 1
    edges = [-(width - 1) + (width * k) // cells for k in range(cells + 1)]

    def run(batches):
        for pdf in batches:
            out = []
            for anchor, cls, starts, off, span, c in zip(pdf["anchor"], pdf["cls"], pdf["starts"], pdf["off"], pdf["span"], pdf["c"]):
                for k in range(cells):
                    a, b = edges[k], edges[k + 1] - 1
                    first, last = max(a, -off) + off, min(b, starts - 1 - off) + off
                    if first <= last:
                        name = _hash(span[b + off : a + length + off], k + 1)
                        out.append((anchor, cls, k, first, last, name, _hash(span[first : last + length], first - off + length), c))
            yield pd.DataFrame(out, columns=["anchor", "cls", "cell", "first", "last", "name", "part", "c"])

    return classes.mapInPandas(run, "anchor long, cls long, cell long, first long, last long, name long, part long, c long")


def _sort_groups(groups: DataFrame, length: int) -> DataFrame:
    """``(anchor, cls, first, last)``: runs of repeated starts, from suffix arrays over whole groups of equal name."""

    def repeats(rows):
        symbols, owner, base, at = [], [], [], 0
        for k, (_, _, first, last, span) in enumerate(rows):
            piece = np.frombuffer(span[first : last + length], np.uint8).astype(np.int64) + 1
            symbols += [piece, np.array([300 + k])]  # a mark of its own ends each span
            owner.append(np.full(last - first + 1, k))
            base.append(at + np.arange(last - first + 1))
            at += len(piece) + 1
        symbols, owner, base = np.concatenate(symbols), np.concatenate(owner), np.concatenate(base)
        may_start = np.full(len(symbols), -1, np.int64)
        may_start[base] = owner
        order = suffix_array(symbols)
        order = order[may_start[order] >= 0]
        same = equal_prefixes(symbols, order, length)
        found = np.zeros(len(symbols), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        at = 0
        for anchor, cls, first, last, _ in rows:
            mine = np.flatnonzero(np.diff(np.concatenate([[False], found[at : at + last - first + 1], [False]]).astype(np.int8)))
            for a, b in mine.reshape(-1, 2).tolist():
                yield anchor, cls, first + a, first + b - 1
            at += last - first + length + 1

    def run(batches):
        held, size, name, columns = [], 0, None, ["anchor", "cls", "first", "last"]
        for pdf in batches:
            out = []
            for key, *row in pdf[["name", "anchor", "cls", "first", "last", "span"]].itertuples(index=False, name=None):
                if key != name and size > BATCH:
                    out += repeats(held)
                    held, size = [], 0
                name = key
                held.append(row)
                size += row[3] - row[2] + length + 1
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(list(repeats(held)), columns=columns)

    dealt = groups.repartition("name").sortWithinPartitions("name")
    return dealt.mapInPandas(run, "anchor long, cls long, first long, last long")


def repeated_ranges(docs: DataFrame, length: int = 200, most: int = 2000) -> DataFrame:
    """``(doc_id, row, ranges)``: byte ranges that a text loses; ``docs`` has ``doc_id``, ``row`` and ``text``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    put, drop = scratch.put, scratch.drop
    anchors = put(_anchors(docs, length))
    bits = min(max(int(16 * anchors.count()).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    wanted, mixed = _bitmap(anchors, bits), _bitmap(anchors.where("a < b"), bits)
    drop(anchors)
    members = put(_members(docs, length, wanted, mixed))
    keys = ["anchor", "cls"]
    counts = members.groupBy(*keys).agg(F.count("*").alias("c"), F.min("starts").alias("starts"), F.min("off").alias("off"))
    counts = put(counts)
    several = put(counts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))
    spans = members.where("span is not null").groupBy(*keys).agg(F.first("span").alias("span"))
    open_ = put(counts.join(several, "anchor", "left_semi").join(spans, keys))

    cells = put(_cells(open_, length, CELLS))
    parts = cells.groupBy("name").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("rows"), F.sum("c").alias("c"))
    shared = put(parts.where("c > 1").select("name", F.col("rows"), (F.col("a") < F.col("b")).alias("differ")))
    twice = cells.groupBy("name", "part").agg(F.sum("c").alias("c")).where("c > 1").select("name", "part")
    whole = cells.where("c = 1").join(twice, ["name", "part"], "left_semi").select(*keys, "first", "last")
    differ = shared.where("differ")
    bound = cells.join(differ.where(F.col("rows") <= most).select("name"), "name").join(open_.select(*keys, "span"), keys)
    sorted_ = _sort_groups(bound.select("name", *keys, "first", "last", "span"), length)
    hot = cells.join(differ.where(F.col("rows") > most).select("name"), "name").groupBy(*keys).agg(F.max("c").alias("c"))
    by_one = _cells(open_.drop("c").join(hot, keys), length, length - ANCHOR + 1)
    by_one = by_one.select(*keys, "first", "last", "c", F.struct("name", "part").alias("w"))
    common = by_one.groupBy("w").agg(F.sum("c").alias("k")).where("k > 1").select("w")
    single = by_one.join(common, "w", "left_semi").select(*keys, "first", "last")

    full = counts.where("c > 1").select(*keys, F.lit(0).cast("long").alias("first"), (F.col("starts") - 1).alias("last"))
    ones = counts.where("c = 1").select(*keys)
    partial = whole.unionByName(sorted_).unionByName(single).join(ones, keys, "left_semi")
    decided = put(full.unionByName(partial))
    hits = members.select("doc_id", "row", "start", *keys).join(decided, keys)
    ranges = hits.select("doc_id", "row", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b")).alias("r"))
    out = put(ranges.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("r")).alias("ranges")))
    for t in (members, cells, shared, open_, counts, several, decided):
        drop(t)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 200, most: int = 2000, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``; with ``keep_text`` what is left of the text, as bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    found = repeated_ranges(docs, length, most)

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, text, ranges in zip(pdf["doc_id"], pdf["text"], pdf["ranges"]):
                b, kept, at, removed, spans = encode(text), [], 0, 0, 0
                end = -1
                for a, z in [] if ranges is None else [(r["a"], r["b"]) for r in ranges]:
                    if a > end:
                        kept.append(b[max(at, 0) : a])
                        spans += 1
                        removed += z - a
                        end = z
                    elif z > end:
                        removed += z - end
                        end = z
                    at = max(at, end)
                kept.append(b[at:])
                left = b"".join(kept)
                rows.append((doc, len(b), removed, spans, hashlib.sha256(left).hexdigest()) + ((left,) if keep_text else ()))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    schema = RESULT + (", kept binary" if keep_text else "")
    same = docs["row"].eqNullSafe(found["row"]) & docs["doc_id"].eqNullSafe(found["doc_id"])
    return docs.join(found, same, "left").select(docs["doc_id"], "text", "ranges").mapInPandas(cut, schema)
