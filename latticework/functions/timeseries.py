"""Time series as a long table ``(id, at, channel, value)``."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket(series: DataFrame, grain: str) -> DataFrame:
    """Per id, channel and calendar grain: count, sum, mean, least and greatest value."""
    keyed = series.withColumn("bucket", F.date_trunc(grain, "at"))
    agg = [F.count("value").alias("n"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")]
    return keyed.groupBy("id", "channel", "bucket").agg(*agg)


def bounds(key: str) -> tuple[date, date]:
    """First and last day of a date written to the year, month or day: ``2020`` is all of its days."""
    parts = [int(x) for x in key.split("-")]
    if not 1 <= len(parts) <= 3:
        raise ValueError(f"no date: {key}")
    low = date(*parts, *[1] * (3 - len(parts)))
    if len(parts) == 3:
        return low, low
    after = date(low.year + 1, 1, 1) if len(parts) == 1 or low.month == 12 else date(low.year, low.month + 1, 1)
    return low, after - timedelta(1)


def between(series: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows from the first day of ``low`` to the last day of ``high``; one key alone is its own range."""
    if low is None and high is None:
        return series
    first = bounds(low)[0] if low else None
    last = bounds(high or low)[1] if high or low else None
    out = series if first is None else series.where(F.col("at") >= F.lit(first).cast("timestamp"))
    return out.where(F.col("at") < F.lit(last + timedelta(1)).cast("timestamp"))


def summary(series: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Per id and channel within the keys: sum (0 of nothing), mean, least, greatest, count, first and last value. Nulls are no values."""
    v = F.col("value")
    known = between(series, low, high).where(v.isNotNull())
    agg = [F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"), F.min_by(v, "at").alias("first"), F.max_by(v, "at").alias("last")]
    found = known.groupBy("id", "channel").agg(*agg)
    keys = series.select("id", "channel").distinct()
    return keys.join(found, ["id", "channel"], "left").withColumn("sum", F.coalesce("sum", F.lit(0.0))).withColumn("count", F.coalesce("count", F.lit(0)))


def at(series: DataFrame, key: str) -> DataFrame:
    """The value on the day, or in the month or year, that the key names: the first there."""
    return between(series, key).groupBy("id", "channel").agg(F.min_by("value", "at").alias("value"))


def delta(series: DataFrame, start: str, end: str) -> DataFrame:
    """Value at ``end`` less value at ``start``."""
    a, b = at(series, start).withColumnRenamed("value", "a"), at(series, end).withColumnRenamed("value", "b")
    return a.join(b, ["id", "channel"]).select("id", "channel", (F.col("b") - F.col("a")).alias("delta"))


def points(series: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """``points``: the rows within the keys as ``(time, value)`` in order of time."""
    pair = F.struct(F.col("at").alias("time"), "value")
    return between(series, low, high).groupBy("id", "channel").agg(F.array_sort(F.collect_list(pair)).alias("points"))


def deltas(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("id", "channel").orderBy("at")
    return series.withColumn("delta", F.col("value") - F.lag("value").over(w))
