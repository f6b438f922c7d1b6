"""String functions with their rules for nulls, Unicode white space and literal delimiters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def trim(c) -> Column:
    """Without Unicode white space at both ends."""
    return ltrim(rtrim(c))


def ltrim(c) -> Column:
    return F.regexp_replace(_c(c), f"^{SPACE}+", "")


def rtrim(c) -> Column:
    return F.regexp_replace(_c(c), f"{SPACE}+$", "")


def split(c, delimiter: str) -> Column:
    """Parts between a literal delimiter, empty ones included; an empty delimiter gives the characters."""
    if delimiter == "":
        return F.filter(F.split(_c(c), ""), lambda x: x != "")
    return F.split(_c(c), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def left(c, n: int) -> Column:
    return F.substring(_c(c), 1, max(n, 0))


def right(c, n: int) -> Column:
    return F.right(_c(c), F.lit(max(n, 0)))


def normalize(c) -> Column:
    """Lower case, letters, digits and single spaces only."""
    bare = F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def jaccard(a, b, separator: str = " ") -> Column:
    """Similarity of the two sets of non-empty parts; two empty sets are alike."""
    x, y = (F.array_distinct(F.filter(split(c, separator), lambda w: w != "")) for c in (a, b))
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), either))


def ngrams(c, n: int) -> Column:
    """All runs of n characters, in order; a shorter text has none."""
    s = _c(c)
    last = F.char_length(s) - F.lit(n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))).when(s.isNotNull(), F.array().cast("array<string>"))


def contains_any(c, needles: list[str]) -> Column:
    out = F.lit(False)
    for x in needles:
        out = out | _c(c).contains(x)
    return out


def starts_with_any(c, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for x in prefixes:
        out = out | _c(c).startswith(x)
    return out


def matches(c, pattern: str, flags: str = "") -> Column:
    """Whether the pattern is found anywhere; flags as in ``(?i)``."""
    return _c(c).rlike(f"(?{flags}){pattern}" if flags else pattern)
