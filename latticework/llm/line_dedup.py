"""Line deduplication with a fixed-depth log-template tree (native: DataFrame operations only).

A line descends by its number of tokens, then its leading tokens, then the rest cut into five segments of equal
length. Tokens with a digit are always variable fields. At the last level a line meets others in six templates: the
one that all of its segments make, and five in which one segment is a variable field, so that lines of one template
agree in at least four fifths of the rest of their positions. A line is dropped if any of its templates occurs in a
document of smaller id: the first document keeps it, repeats within a document are left alone.

Short lines agree by chance more often, so they need support: lines of four to seven tokens have a variable field of one
token after the first (of four or five) or the first two, and such a template counts if ``support`` documents or more have it;
a line of one or two tokens goes if it is the same in as many. A long line has one variable segment, not two.

Only 64-bit template hashes and ids are shuffled, with minima pre-aggregated, and never all lines of a template; texts
are read a second time and lose the lines whose positions were marked.

Defined cases: null text stays null with 0 lines; a document of which all lines go has an empty text; rows that share
an id count as one document, yet each loses its own lines; rows with a null id are returned unchanged; other columns
are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.storage import Scratch

LEAD, PARTS = 3, 5
SPACES = r"[ \t\x0B\f\r]+"
FIELD = r"[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*"


def _lines(docs: DataFrame) -> DataFrame:
    """``(id, row, pos, n, full, part0..part4)``: number of tokens and template hashes of each line that has any."""
    lines = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", FIELD, "<*>")).otherwise(F.col("line"))
    words = lines.select("id", "row", "pos", F.split(F.trim(F.regexp_replace(masked, r"^[\t\x0B\f\r ]+|[\t\x0B\f\r ]+$", "")), SPACES).alias("t"))
    words = words.withColumn("n", F.size("t")).where("t[0] <> ''")
    rest = f"greatest(n - {LEAD}, 0)"
    hashes = [
        F.expr(f"xxhash64(slice(t, {LEAD + 1} + ({i} * {rest}) div {PARTS}, int((({i + 1} * {rest}) div {PARTS}) - (({i} * {rest}) div {PARTS}))))").alias(f"s{i}")
        for i in range(PARTS)
    ]
    # short lines: the token at this place is the field, if there is one
    place = lambda i: f"(if(n <= 5, 2, 3) + {i})"
    short = [
        F.when(F.col("n").between(4, LEAD + PARTS - 1) & F.expr(f"{place(i)} <= n"), F.expr(f"xxhash64(-1 - {i}, n, slice(t, 1, {place(i)} - 1), slice(t, {place(i)} + 1, greatest(n - {place(i)}, 0)))")).alias(f"w{i}")
        for i in range(PARTS)
    ]
    cut = words.select("id", "row", "pos", "n", F.expr(f"xxhash64(n, slice(t, 1, {LEAD}))").alias("lead"), *hashes, *short)
    segments = [f"s{i}" for i in range(PARTS)]
    holes = [
        F.when(F.col("n") >= LEAD + PARTS, F.xxhash64(F.lit(i), "lead", *[s for j, s in enumerate(segments) if j != i])).otherwise(F.col(f"w{i}")).alias(f"part{i}")
        for i in range(PARTS)
    ]
    return cut.select("id", "row", "pos", "n", F.xxhash64("lead", *segments).alias("full"), *holes)


def marked_lines(docs: DataFrame, min_tokens: int = 3, support: int = 10) -> DataFrame:
    """``(id, row, gone)``: positions of the lines that a document loses; ``row`` is the hash of its text.

    Lines of ``min_tokens`` or more go if two documents have them, shorter ones if ``support`` documents do.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.put(_lines(docs))
    holes = [f"part{i}" for i in range(PARTS)]
    full = scratch.put(lines.groupBy("full", *holes).agg(F.first("n").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")))
    long = F.col("n") >= LEAD + PARTS
    keyed = full.where(long).select("full", "first", "last", F.explode(F.array(*holes)).alias("hole"))
    firsts = keyed.groupBy("hole").agg(F.min("first").alias("least"), F.max("last").alias("most")).where("least < most")
    by_hole = keyed.join(firsts, "hole").where("least < last").groupBy("full").agg(F.min("least").alias("least"))
    same = full.where((F.col("first") < F.col("last")) & (F.col("n") >= min_tokens)).select("full", F.col("first").alias("least"))
    # short lines: documents are counted exactly, each once
    keys = F.when(F.col("n") < min_tokens, F.array("full")).otherwise(F.filter(F.array(*holes), lambda x: x.isNotNull()))
    short = ~long & ((F.col("n") < min_tokens) | F.col("part0").isNotNull())
    had = lines.where(short).select("id", F.explode(keys).alias("key")).distinct()
    often = had.groupBy("key").agg(F.count("*").alias("docs"), F.min("id").alias("least")).where(F.col("docs") >= support).select("key", "least")
    by_support = full.where(short).select("full", F.explode(keys).alias("key")).join(often, "key").groupBy("full").agg(F.min("least").alias("least"))
    least = same.unionByName(by_hole).unionByName(by_support)
    least = scratch.put(least.groupBy("full").agg(F.min("least").alias("least")))
    gone = lines.select("id", "row", "pos", "full").join(least, "full").where("id > least")
    return gone.groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))


def drop_lines(docs: DataFrame, min_tokens: int = 3, support: int = 10) -> DataFrame:
    """All columns, with ``text`` without the dropped lines, then ``n_lines`` and ``n_dropped``."""
    marks = marked_lines(docs, min_tokens, support).select(F.col("id").alias("_lt_id"), F.col("row").alias("_lt_row"), F.col("gone").alias("_lt_gone"))
    joined = docs.withColumn("_lt_key", F.xxhash64("text")).join(marks, (F.col("doc_id") == F.col("_lt_id")) & (F.col("_lt_key") == F.col("_lt_row")), "left")
    kept = F.expr(r"array_join(filter(split(text, '\n'), (x, i) -> not array_contains(_lt_gone, i)), '\n')")
    columns = [F.when(F.col("_lt_gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *columns,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("_lt_gone").isNull(), 0).otherwise(F.size("_lt_gone")).cast("long").alias("n_dropped"),
    )
