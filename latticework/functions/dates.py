"""Dates and durations: partial dates, differences by component, calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def date_of(c) -> Column:
    """``YYYY``, ``YYYY-M`` or ``YYYY-M-D``; other text is null."""
    s = _c(c).cast("string")
    part = lambda k: F.nullif(F.regexp_extract(s, r"^(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?$", k), F.lit(""))
    whole = F.concat_ws("-", part(1), F.lpad(F.coalesce(part(2), F.lit("1")), 2, "0"), F.lpad(F.coalesce(part(3), F.lit("1")), 2, "0"))
    return F.when(part(1).isNotNull(), whole.try_cast("date"))


def datetime_of(c) -> Column:
    """An ISO time; a date is its midnight; other text is null."""
    s = _c(c).cast("string")
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), s.try_cast("timestamp")), date_of(s).cast("timestamp"))


def duration_between(a, b) -> Column:
    """Days and seconds from a to b; no months, since they have no length of their own."""
    seconds = F.unix_seconds(_c(b).cast("timestamp")) - F.unix_seconds(_c(a).cast("timestamp"))
    days = F.floor(seconds / 86_400)
    return F.struct(F.lit(0).alias("months"), days.cast("int").alias("days"), (seconds - days * 86_400).alias("seconds"))


def days_between(a, b) -> Column:
    return F.datediff(_c(a), _c(b)).cast("long")


def add_days(c, n) -> Column:
    return F.date_add(_c(c).cast("date"), n)


def add_months(c, n) -> Column:
    return F.add_months(_c(c).cast("date"), n)


def add_years(c, n: int) -> Column:
    """The 29th of February becomes the 28th in other years."""
    return F.add_months(_c(c).cast("date"), 12 * n)


def truncate(c, unit: str) -> Column:
    """First day of the year, quarter, month or week (Monday)."""
    return F.trunc(_c(c).cast("date"), unit)
