"""Queries over time: what was valid at a moment, and what changed from one sighting to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.asof import as_of
from shelfmark.plans.queries_text import query, read
from shelfmark.streaming import changes as C


@query(
    """WITH h AS (SELECT user_id, ts AS since, max(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
    SELECT event_id, CAST(epoch_us(since) AS BIGINT) AS since_us, paid FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.ts >= h.since"""
)
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event with its user's last purchase until then."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    history = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("paid"), F.unix_micros("ts").alias("since_us"))
    return as_of(events.filter("event_type <> 'purchase'"), history, "user_id", "ts", "since", ["paid", "since_us"]).select("event_id", "since_us", "paid")


@query(
    """WITH h AS (SELECT l_partkey, l_shipdate AS since, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
    SELECT l_orderkey, l.l_partkey, l_suppkey, l_linenumber, l_extendedprice, price FROM (SELECT * FROM lineitem WHERE l_returnflag <> 'A') l ASOF LEFT JOIN h ON l.l_partkey = h.l_partkey AND l.l_shipdate >= h.since"""
)
def asof_part_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the price of their part that was valid when they were shipped."""
    items = read(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    history = items.filter("l_returnflag = 'A'").select("l_partkey", F.col("l_shipdate").alias("since"), F.col("l_extendedprice").alias("price"))
    met = as_of(items.filter("l_returnflag <> 'A'"), history, "l_partkey", "l_shipdate", "since", ["price"], "365 days")
    return met.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "price")


_UNTIL = "2002-01-01"


@query(
    f"""WITH s AS (SELECT CAST(l_partkey AS VARCHAR) AS offer, CAST(l_shipdate AS TIMESTAMP) AS at_, min(l_extendedprice) AS price, sum(l_quantity) AS stock FROM lineitem GROUP BY ALL),
    w AS (SELECT *, lag(price) OVER o AS was, lag(stock) OVER o AS had, lag(at_) OVER o AS last, lead(at_) OVER o AS nxt FROM s WINDOW o AS (PARTITION BY offer ORDER BY at_)),
    f AS (SELECT *, last IS NULL OR at_ > last + INTERVAL 60 DAYS AS fresh FROM w)
    SELECT offer, strftime(at_, '%Y-%m-%d') AS day, 'new' AS kind, CAST(NULL AS DOUBLE) AS before, price AS after FROM f WHERE fresh
    UNION ALL SELECT offer, strftime(at_, '%Y-%m-%d'), 'price', was, price FROM f WHERE NOT fresh AND was IS DISTINCT FROM price
    UNION ALL SELECT offer, strftime(at_, '%Y-%m-%d'), 'stock', had, stock FROM f WHERE NOT fresh AND had IS DISTINCT FROM stock
    UNION ALL SELECT offer, strftime(at_ + INTERVAL 60 DAYS, '%Y-%m-%d'), 'stale', price, NULL FROM f WHERE (nxt IS NULL OR nxt > at_ + INTERVAL 60 DAYS) AND at_ + INTERVAL 60 DAYS < TIMESTAMP '{_UNTIL}'"""
)
def offer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, changed and stale offers by ship date; ``tests/test_streaming.py`` holds the stateful stream against the same rows."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("offer"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("stock"))
    told = C.changes(C.sightings(rows), 60, _UNTIL)
    return told.select("offer", F.date_format("at", "yyyy-MM-dd").alias("day"), "kind", "before", "after")
