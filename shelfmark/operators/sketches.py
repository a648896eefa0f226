"""Facet counts and health figures that are kept and merged instead of counted anew.

*Sketches* are small summaries of a group of rows (distinct values, quantiles, frequent values).
Those of any groups can be merged into those of larger ones without reading a row again.
*Bitmaps* hold which entries have a facet value, as bits by the entry's number; how many entries
have several values at once is the number of bits left by AND.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary logarithm of the registers of a distinct count, entries of a quantile sketch, and values tracked by a top-k sketch.
LG_REGISTERS, KLL_K, TRACKED = 12, 200, 10_000
#: Three standard errors of a distinct count with so many registers, and the rank error of a quantile sketch (99 % of cases).
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2), 0.0266


def summarised(rows: DataFrame, by: list[str | Column], key: str, amount: str, value: str) -> DataFrame:
    """One row for each group: ``n``, and sketches of distinct ``key``, of the quantiles of ``amount``, of frequent ``value``.

    Nulls are in ``n`` alone.
    """
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.col(key), F.lit(LG_REGISTERS)).alias("keys"),
        F.kll_sketch_agg_double(F.col(amount).cast("double"), F.lit(KLL_K)).alias("amounts"), F.expr(f"approx_top_k_accumulate({value}, {TRACKED})").alias("values"),
    )


def merged(groups: DataFrame, by: list[str]) -> DataFrame:
    """Groups of :func:`summarised` brought together by fewer keys (or none), from their sketches alone."""
    return groups.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double(F.col("amounts")).alias("amounts"), F.expr(f"approx_top_k_combine(values, {TRACKED})").alias("values"),
    )


def told(groups: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = 5) -> DataFrame:
    """What the sketches say: ``distinct``, ``quantiles``, ``top`` (value and count) beside the group's keys and ``n``."""
    keys = [c for c in groups.columns if c not in ("n", "keys", "amounts", "values")]
    ranks = F.array(*[F.lit(q) for q in quantiles])
    return groups.select(*keys, "n", F.hll_sketch_estimate("keys").alias("distinct"), F.kll_sketch_get_quantile_double("amounts", ranks).alias("quantiles"), F.expr(f"approx_top_k_estimate(values, {k})").alias("top"))


def numbered(entries: DataFrame, key: str) -> DataFrame:
    """``entries`` with ``ordinal``, from 0 without gaps, range by range in the order of ``key``: no task sorts them all."""
    from shelfmark.sources.stages import staged

    ranged = staged(entries.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ordinals")
    # A row for each range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(key)
    return ranged.join(F.broadcast(starts), "_range").withColumn("ordinal", F.col("_start") + F.row_number().over(within) - 1).drop("_range", "_start")


def facet_bitmaps(entries: DataFrame, facets: list[str]) -> DataFrame:
    """``facet``, ``value``, ``bucket``, ``bits`` of entries with an ``ordinal``: 4096 bytes a bucket at most; nulls have no value."""
    said = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    rows = entries.select("ordinal", said.alias("x")).select("ordinal", "x.*").filter("value is not null")
    return rows.groupBy("facet", "value", F.bitmap_bucket_number("ordinal").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("bits"))


def selected(bitmaps: DataFrame, selections: DataFrame) -> DataFrame:
    """``selection``, ``n``: how many entries have all values of each selection; ``selections`` has ``selection``, ``facet``, ``value``.

    A value that no entry has leaves none.
    """
    wanted = selections.distinct()
    sizes = wanted.groupBy("selection").agg(F.count("*").alias("asked"))
    met = wanted.join(bitmaps, ["facet", "value"]).groupBy("selection", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("had"))
    # A bucket in which one of the values has no bits has no bitmap for it.
    whole = met.join(sizes, "selection").filter("had = asked").groupBy("selection").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return sizes.join(whole, "selection", "left").select("selection", F.coalesce("n", F.lit(0)).alias("n"))
