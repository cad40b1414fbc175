"""Windows over event time; the same plans run on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """(start, by, n, total): counts and sums of value per window; on a stream late events are taken up to late."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """(user, session, started, ended, n): runs of events with no gap over gap_seconds, from 1."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((at - F.lag(at).over(w)) > gap_seconds * 1_000_000, F.lit(True))
    marked = events.withColumn("_new", new.cast("long")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def once(events: DataFrame, token: str, ts: str, late: str) -> DataFrame:
    """Each token once: exactly on a table, within the watermark on a stream."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([token]) if events.isStreaming else events.dropDuplicates([token])


def running_max(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """rows with progress: never falling, at most 100."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("progress", F.least(F.max(value).over(w), F.lit(100)))
