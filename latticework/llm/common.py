"""Small helpers that the corpus operators share."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs without ASCII white space; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fold(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(c.cast("string").cast("binary")) % n


def encode(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The ``most`` rows of largest positive counts, or all where there are no more; nothing is sorted as a whole.

    Counts are compared in steps of a thousandth (exactly below 2,048). Of the step that doesn't fit as a whole, rows are
    taken by a hash of the row, and of the last hash bucket by order. Only two histograms, of at most 65,536 numbers each, reach
    the driver.
    """
    bits = "greatest(length(bin({0})) - 11, 0)".format(count)
    step = F.expr(f"int({bits} * 1024 + shiftright({count}, {bits}))")
    bucket = F.pmod(F.xxhash64(*counted.columns), F.lit(1 << 16)).cast("int")

    def fit(rows: DataFrame, key: Column, room: int) -> tuple[int, int]:
        """The largest keys that fit as a whole go from the second number's successor on; the first: rows left over."""
        found = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).toArrow()
        k, n = found["k"].to_numpy(), found["n"].to_numpy()
        order = np.argsort(-k)
        total = np.cumsum(n[order])
        over = np.flatnonzero(total > room)
        if not len(over):
            return 0, -1
        taken = int(total[over[0] - 1]) if over[0] else 0
        return room - taken, int(k[order][over[0]])

    left, edge = fit(counted, step, most)
    out = counted.where(step > edge)
    if edge < 0 or not left:
        return out
    tied = counted.where(step == edge)
    left, last = fit(tied, bucket, left)
    out = out.unionByName(tied.where(bucket > last))
    return out.unionByName(tied.where(bucket == last).orderBy(*counted.columns).limit(left)) if left else out
