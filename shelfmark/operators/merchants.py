"""Which merchants sell the same article: offers joined by trade item numbers, or by brand and part number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.binding import let
from shelfmark.operators.components import connected_components
from shelfmark.sources.stages import staged

#: Lengths that trade item numbers have; all are written with 14 digits.
LENGTHS = (8, 12, 13, 14)


def gtin14(raw: Column) -> Column:
    """A trade item number with 14 digits; null if its length or its check digit is wrong, or it is all zeros.

    Blanks and hyphens between the digits do not count.
    """

    def sound(n: Column) -> Column:
        # From the right, every other digit counts three times.
        digits = [F.floor(n / 10**i) % 10 * (3 if i % 2 else 1) for i in range(14)]
        return reduce(Column.__add__, digits) % 10 == 0

    def checked(full: Column) -> Column:
        return F.when(let(full.cast("long"), sound) & (full != "0" * 14), full)

    plain = F.regexp_replace(F.trim(raw), r"(?<=\d)[ -](?=\d)", "")
    good = plain.rlike(r"^\d+$") & F.length(plain).isin(*LENGTHS)
    return F.when(good, let(F.lpad(plain, 14, "0"), checked))


def part_number(brand: Column, mpn: Column) -> Column:
    """Brand and manufacturer's part number as one key, letters and digits alone; null if either has none."""

    def plain(c: Column) -> Column:
        return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))

    return F.concat(plain(brand), F.lit("/"), plain(mpn))


def name_words(name: Column) -> Column:
    """The words of a name, each once and in order of the alphabet, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != ""))), " ")


def same_articles(offers: DataFrame, id_col: str = "offer_id") -> DataFrame:
    """``offer_id``, ``article`` (the smallest offer id of the article) for every offer with an id.

    Expects ``gtin``, ``brand``, ``mpn``, ``name``.  Offers are of one article if a valid trade item
    number says so, or if brand and part number do and the names have the same words: part numbers
    are reused, so the names must agree.  Valid trade item numbers that differ keep offers apart only
    where nothing else joins them.  Each key stands for the first offer that has it, so that only
    the keys which an offer has both of are linked, not the offers: a key that a third of all offers
    have is one vertex.
    """
    rows = offers.select(F.col(id_col).cast("long").alias("id"), gtin14(F.col("gtin")).alias("number"), part_number(F.col("brand"), F.col("mpn")).alias("part"), name_words(F.col("name")).alias("words")).filter("id is not null")
    by = F.array_compact(F.array(F.when(F.col("number").isNotNull(), F.concat(F.lit("g/"), "number")), F.when(F.col("part").isNotNull() & (F.col("words") != ""), F.concat(F.lit("m/"), "part", F.lit("/"), "words"))))
    keyed = staged(rows.select("id", F.explode_outer(by).alias("key")), "article-keys")
    said = keyed.filter("key is not null")
    first = said.groupBy("key").agg(F.min("id").alias("least"))
    ends = said.join(first, "key").select("id", "least").unionByName(keyed.filter("key is null").select("id", F.col("id").alias("least")))
    placed = staged(ends.groupBy("id").agg(F.min("least").alias("a"), F.max("least").alias("b")), "article-ends")
    roots = connected_components(placed.filter("a <> b").select("a", "b"))
    return placed.join(roots, F.col("a") == F.col("node"), "left").select(F.col("id").alias(id_col), F.coalesce("root", "a").alias("article"))
