"""Queries that join offers and addresses across the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.merchants import same_articles
from shelfmark.operators.tokens import tokens_in_urls
from shelfmark.plans.queries_text import query, read


def _check_digit(body: Column) -> Column:
    """The check digit of a number of 13 digits."""
    weighed = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.substr(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return (10 - F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10) % 10


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``offer_id``, ``gtin``, ``brand``, ``mpn``, ``name``: each part as each of its suppliers sells it, numbered in five ways.

    By supplier: 12, 13 and 14 digits of the same number, the last with hyphens; a wrong check digit;
    a wrong one and no part number.  Even suppliers among the first three state the part number too.
    """
    sold = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_brand", "p_name")
    body = F.lpad((F.col("p") + 10_000_000_000).cast("string"), 13, "0")
    digit = _check_digit(body).cast("int")
    right, wrong = F.concat(body, digit.cast("string")), F.concat(body, ((digit + 1) % 10).cast("string"))
    way = F.col("s") % 5
    gtin = F.when(way == 0, F.substr(right, F.lit(3), F.lit(12))).when(way == 1, F.substr(right, F.lit(2), F.lit(13))).when(way == 2, F.concat(F.substr(right, F.lit(1), F.lit(7)), F.lit("-"), F.substr(right, F.lit(8), F.lit(7)))).otherwise(wrong)
    mpn = F.when((way == 3) | ((way < 3) & (F.col("s") % 2 == 0)), F.format_string("MP-%s", "p"))
    words = F.when(F.col("s") % 3 == 0, F.concat_ws(" ", "p_name", "p")).otherwise(F.concat_ws(", ", F.upper(F.col("p").cast("string")), F.initcap("p_name")))
    return sold.join(part, "p").select((F.col("p") * 1_000_000 + F.col("s")).cast("long").alias("offer_id"), gtin.alias("gtin"), F.col("p_brand").alias("brand"), mpn.alias("mpn"), words.alias("name"))


@query(
    """WITH o AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
    g AS (SELECT p, min(s) FILTER (s % 5 < 3) AS by_number, min(s) FILTER (s % 5 = 3) AS by_part, coalesce(bool_or(s % 5 < 3 AND s % 2 = 0), false) AS joined FROM o GROUP BY p)
    SELECT p * 1000000 + s AS offer_id, p * 1000000 + CASE WHEN s % 5 = 4 THEN s WHEN joined THEN least(by_number, coalesce(by_part, by_number)) WHEN s % 5 = 3 THEN by_part ELSE by_number END AS article FROM o JOIN g USING (p)"""
)
def merchants_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of one article by trade item number, whatever its length, or by brand and part number."""
    return same_articles(offers(spark, sf_dir))


@query("SELECT page_id, token FROM pages, (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS token FROM lineitem) WHERE contains(url, token)")
def part_numbers_in_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part numbers occur in which addresses; the SQL compares all pairs."""
    return tokens_in_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("token")))
