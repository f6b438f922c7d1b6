"""Packing of tokenised documents into fixed-length sequences: shortest pack first over the length histogram.

Documents longer than a sequence are cut into full pieces and a remainder. Only the histogram of piece lengths (at
most ``length`` counts) reaches the driver; patterns of lengths are built from it, longest lengths first, each going to
the open packs with the most room. Pieces find their pack by rank among those of equal length. The rank is a row
number within a salted part of the length plus the part's offset, so one length may hold most of the rows.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; ties in rank go by id and
start; extra columns are ignored; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.llm import tokens
from latticework.storage import Scratch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, length: int = 2048, end_id: int = 1, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece of each document's ids (its tokens, then ``end_id``); with ``keep_ids`` the ids too."""

    def pieces(batches):
        encoder = tokens.byte_bpe(vocabulary)
        for pdf in batches:
            rows, arrays = [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(tokens.ids_of(encoder, text), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    if keep_ids:
                        arrays.append(part.astype(np.int32))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(ids=arrays) if keep_ids else out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, PIECES + (", ids array<int>" if keep_ids else ""))


def patterns(histogram: dict[int, int], length: int = 2048) -> list[tuple[int, list[int]]]:
    """``(count, lengths)``: how many packs hold which lengths."""
    room: list[list[list]] = [[] for _ in range(length + 1)]  # open packs by what still fits
    for size in sorted(histogram, reverse=True):
        left, widest = histogram[size], length
        while left:
            while widest >= size and not room[widest]:
                widest -= 1
            if widest < size:
                room[length - size].append([left, [size]])
                break
            count, held = room[widest].pop()
            used = min(count, left)
            if used < count:
                room[widest].append([count - used, held])
            room[widest - size].append([used, [*held, size]])
            left -= used
    return [(count, held) for packs in room for count, held in packs]


def placements(packs: list[tuple[int, list[int]]], histogram: dict[int, int]) -> dict[str, np.ndarray]:
    """Intervals of ranks: where the ranks of each length, numbered one length after another, go."""
    base, at = {}, 0
    for size in sorted(histogram):
        base[size], at = at, at + histogram[size]
    given, rows, sequence = Counter(), [], 0
    for count, held in packs:
        offset = 0
        for size in held:
            rows.append((base[size] + given[size], sequence, offset))
            given[size] += count
            offset += size
        sequence += count
    rows.sort()
    first, seq, offset = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
    return {"first": first, "sequence": seq, "offset": offset, "base": np.array([base.get(i, 0) for i in range(max(base, default=0) + 1)], np.int64)}


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.put(cut(docs, length, end_id, vocabulary, keep_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = placements(patterns(histogram, length), histogram)

    salts = max(64, sum(histogram.values()) // 100_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("row", F.row_number().over(within)).join(parts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("skip") + F.col("row") - 1).drop("salt", "row", "skip")

    def place(batches):
        for pdf in batches:
            rank = plan["base"][pdf["length"].to_numpy()] + pdf["rank"].to_numpy()
            k = np.searchsorted(plan["first"], rank, "right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=plan["sequence"][k] + rank - plan["first"][k], offset=plan["offset"][k])

    columns = pieces.columns
    schema = PIECES + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInPandas(place, schema)
