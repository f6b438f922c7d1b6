"""Change feed of a node table: versions compared to events, and events read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "version long, operation string, id long, before string, after string"


def changes(before: DataFrame, after: DataFrame, version: int) -> DataFrame:
    """Created, updated and deleted rows between two snapshots with an ``id``; states as JSON."""
    state = lambda f, name: f.select(F.col("id"), F.to_json(F.struct(*sorted(f.columns)), {"ignoreNullFields": "false"}).alias(name))
    both = state(before, "before").join(state(after, "after"), "id", "full")
    kind = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
    differ = both.where(~F.col("before").eqNullSafe(F.col("after")))
    return differ.select(F.lit(version).cast("long").alias("version"), kind.alias("operation"), F.col("id").cast("long").alias("id"), "before", "after")


def append(feed: str, events: DataFrame) -> None:
    events.write.mode("append").parquet(feed)


def query(spark: SparkSession, feed: str, after_version: int = -1, operations: list[str] | None = None) -> DataFrame:
    """Events after a cursor, oldest first."""
    rows = spark.read.schema(EVENT).parquet(feed).where(F.col("version") > after_version)
    rows = rows if operations is None else rows.where(F.col("operation").isin(operations))
    return rows.orderBy("version", "id")


def stream(spark: SparkSession, feed: str) -> DataFrame:
    """The feed as a streaming source: new files are new events."""
    return spark.readStream.schema(EVENT).parquet(feed)


def counts_by_operation(events: DataFrame) -> DataFrame:
    return events.groupBy("operation").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of ``(ts, user_id)`` events; works on a table and, with the watermark, on a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
