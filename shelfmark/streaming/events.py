"""Windows over event streams; each works on a static table and on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``ts`` as a timestamp with a zone, which watermarks need, and the watermark on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """``start``, ``event_type``, ``n``, ``total`` per window."""
    sums = timed(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    sums = timed(events, delay).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """``user_id``, ``start``, ``n``: activity without a pause of ``gap``."""
    sums = timed(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return sums.select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_within(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Each key once; on a stream, repeats are remembered for the watermark's delay."""
    rows = timed(events, delay)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Rows of ``left`` with those of ``right`` that have their key and come at their time or up to ``within`` later; each at least once.

    On streams both sides have a watermark: rows up to ``delay`` late are met, and a row without a
    partner is told when none can come any more, and then only.  Column names other than the key's
    must differ.
    """
    l_rows, r_rows = (rows.withWatermark(time, delay) if rows.isStreaming else rows for rows, time in ((left, left_time), (right, right_time)))
    met = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    return l_rows.alias("l").join(r_rows.alias("r"), met, "left_outer").select("l.*", *[F.col(f"r.{c}") for c in right.columns if c != key])
