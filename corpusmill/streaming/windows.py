"""Event-time windows and sessions; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with ts as a timestamp (watermarks refuse timestamps without a zone)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    by = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    by = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def batch_sessions(events: DataFrame, gap_minutes: int = 30, by: str = "user_id") -> DataFrame:
    """The sessions of a finished table: (by, start, end, n). An event within the gap after the one before joins its session; a
    session ends a gap after its last event. Events without a time are left out.

    Borders are found inside hours and against the last hour's latest event, and counted on over hours, so a user who has a
    third of all events is spread over their hours.
    """
    gap = gap_minutes * 60_000_000
    rows = events.where("ts IS NOT NULL").select(by, "ts", F.unix_micros("ts").alias("__at"), F.date_trunc("hour", "ts").alias("__hour"))
    hours = Window.partitionBy(by).orderBy("__hour")  # one row an hour
    latest = rows.groupBy(by, "__hour").agg(F.max("__at").alias("__max"))
    earlier = latest.select(F.col(by).alias("__by"), F.col("__hour").alias("__h"), F.lag("__max").over(hours).alias("__earlier"))
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__hour") == F.col("__h"))
    inside = Window.partitionBy(by, "__hour").orderBy("__at")
    marked = rows.withColumn("__last", F.lag("__at").over(inside)).join(earlier, same).drop("__by", "__h")
    before = F.coalesce("__last", "__earlier")
    marked = marked.withColumn("__new", F.coalesce((F.col("__at") - before >= gap).cast("int"), F.lit(1)))
    counts = marked.groupBy(by, "__hour").agg(F.sum("__new").alias("__n"))
    sums = counts.select(F.col(by).alias("__by"), F.col("__hour").alias("__h"), F.sum("__n").over(hours.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    numbered = marked.withColumn("__inside", F.sum("__new").over(inside)).join(sums, same)
    session = (F.coalesce("__before", F.lit(0)) + F.col("__inside")).alias("__session")
    ends = F.timestamp_micros(F.max("__at") + gap).alias("end")
    return numbered.groupBy(by, session).agg(F.min("ts").alias("start"), ends, F.count(F.lit(1)).alias("n")).drop("__session")


def elapsed(events: DataFrame, by: str = "user_id") -> DataFrame:
    """(by, event_id, micros): microseconds since the group's event before, by time and id; null for its first. Batch only.

    Events without a time are left out. Neighbours are found inside hours; an hour's first event follows the last hour's
    latest, so a group that holds a third of all events is spread over its hours.
    """
    rows = events.where("ts IS NOT NULL").select(by, "event_id", F.unix_micros("ts").alias("__at"), F.date_trunc("hour", "ts").alias("__hour"))
    inside = rows.withColumn("__last", F.lag("__at").over(Window.partitionBy(by, "__hour").orderBy("__at", "event_id")))
    hours = rows.groupBy(by, "__hour").agg(F.max("__at").alias("__max"))
    earlier = hours.select(F.col(by).alias("__by"), F.col("__hour").alias("__h"), F.lag("__max").over(Window.partitionBy(by).orderBy("__hour")).alias("__earlier"))
    joined = inside.join(earlier, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__hour") == F.col("__h")))
    return joined.select(by, "event_id", (F.col("__at") - F.coalesce("__last", "__earlier")).alias("micros"))
