"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a map-side combined minimum per vertex and an equi-join, so a vertex of very high
degree neither meets in one task (its minimum is combined before the shuffle, its join partition
can be split) nor multiplies rows: a step never makes more edges than it read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every vertex that is not the smallest of its component.

    A vertex absent from the result is its own root.  Loops, repeated edges and nulls are ignored.
    The rounds needed grow with the logarithm of the longest path; ``max_rounds`` only guards
    against a defect and raises, it never returns an unfinished result.
    """
    x, y = F.col(a), F.col(b)
    now = materialise(edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    seen = _signature(now)
    if not seen[0]:
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialise(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        if (then := _signature(now)) == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = then
    raise RuntimeError("components did not settle")
