"""Conversions and numeric functions that give null where a result is undefined, never NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def finite(c) -> Column:
    """Null for NaN and infinity."""
    x = _c(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_integer(c) -> Column:
    """Text of digits with an optional sign, without spaces; null for all else."""
    return F.when(_c(c).rlike(r"^[+-]?[0-9]+$"), _c(c).try_cast("bigint"))


def to_float(c) -> Column:
    return finite(F.when(_c(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), _c(c).try_cast("double")))


def round_half_away(c, digits: int = 0) -> Column:
    return F.round(_c(c).cast("double"), digits)


def sqrt(c) -> Column:
    return F.when(_c(c) >= 0, F.sqrt(_c(c)))


def asin(c) -> Column:
    return F.when(_c(c).between(-1, 1), F.asin(_c(c)))


def acos(c) -> Column:
    return F.when(_c(c).between(-1, 1), F.acos(_c(c)))


def log10(c) -> Column:
    return F.when(_c(c) > 0, F.log10(_c(c)))


def power(a, b) -> Column:
    return finite(F.pow(_c(a), _c(b)))


def cot(c) -> Column:
    return F.try_divide(F.cos(_c(c)), F.sin(_c(c)))


def haversin(c) -> Column:
    return (1 - F.cos(_c(c))) / 2
