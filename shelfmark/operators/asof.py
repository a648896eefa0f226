"""What was valid at a time: rows of a history met by key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, history: DataFrame, key: str, at: str, since: str, values: list[str], width: str = "1 day") -> DataFrame:
    """``rows`` (all of them, with all their columns) with ``values`` of the history entry valid at their time ``at``.

    That is the entry of the same ``key`` with the latest ``since`` not after ``at``; of entries with
    equal key and time the one with the greatest values.  Where there is none, and for null keys and
    times, the values are null.

    Rows and history are brought together once, by key and slice of ``width``, and sorted there; the
    last entry is carried along.  What a slice inherits from those before it is one row a slice, so
    that a key with a large part of all rows is cut into as many tasks as it has slices.
    """

    def cut(time: Column) -> Column:
        return F.window(time, width)["start"]

    entry = F.struct(*[F.col(v) for v in values])
    past = history.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(since).cast("timestamp").alias("_time")).agg(F.max(entry).alias("_entry"))
    past = past.withColumn("_slice", cut(F.col("_time")))
    body = rows.select(F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_time"), F.struct("*").alias("_row"))
    known = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    asked = body.filter(known).withColumn("_slice", cut(F.col("_time")))
    # One row for each key and slice: what it ends with, and whether anything is asked in it.
    ends = past.groupBy("_key", "_slice").agg(F.max_by("_entry", "_time").alias("_last")).withColumn("_asked", F.lit(False))
    wanted = asked.select("_key", "_slice").distinct().select("_key", "_slice", F.lit(None).cast(ends.schema["_last"].dataType).alias("_last"), F.lit(True).alias("_asked"))
    merged = ends.unionByName(wanted).groupBy("_key", "_slice").agg(F.first("_last", ignorenulls=True).alias("_last"), F.max("_asked").alias("_asked"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = merged.withColumn("_entry", F.last("_last", ignorenulls=True).over(before)).filter(F.col("_asked") & F.col("_entry").isNotNull())
    no_row, no_entry = F.lit(None).cast(body.schema["_row"].dataType), F.lit(None).cast(past.schema["_entry"].dataType)
    stream = (
        carried.select("_key", "_slice", F.lit(None).cast("timestamp").alias("_time"), F.lit(0).alias("_kind"), "_entry", no_row.alias("_row"))
        .unionByName(past.select("_key", "_slice", "_time", F.lit(1).alias("_kind"), "_entry", no_row.alias("_row")))
        .unionByName(asked.select("_key", "_slice", "_time", F.lit(2).alias("_kind"), no_entry.alias("_entry"), "_row"))
    )
    along = Window.partitionBy("_key", "_slice").orderBy(F.col("_time").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = stream.withColumn("_entry", F.last("_entry", ignorenulls=True).over(along)).filter("_kind = 2").select("_row", "_entry")
    return met.unionByName(body.filter(~known).select("_row", no_entry.alias("_entry"))).select("_row.*", *[F.col(f"_entry.{v}").alias(v) for v in values])
