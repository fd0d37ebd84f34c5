"""Windows over event time, the same expressions for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Counts and sums of an event type by the hour."""
    hour = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("hour")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")
    return events.groupBy("event_type", hour).agg(F.count("*").alias("n"), cents, F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """A user's events fall into one session while each is at most so many minutes after the one before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = events.withColumn("first", F.coalesce((F.col("ts") - F.lag("ts").over(order) > F.expr(f"interval {minutes} minutes")).cast("int"), F.lit(1)))
    numbered = starts.withColumn("session", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"))


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """hourly for a stream: an hour is final once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
