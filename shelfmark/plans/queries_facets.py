"""Facet counts and health figures from summaries that are kept, held against exact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import sketches as S
from shelfmark.plans.queries_text import query, read
from shelfmark.sources.stages import staged


@query(
    """WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, arg_max(l_linenumber, (k, -l_linenumber)) AS top_value, max(k) AS top_count FROM c GROUP BY l_returnflag)
    SELECT l_returnflag, count(*) AS n, true AS distinct_ok, true AS quantiles_ok, any_value(top_value) AS top_value, any_value(top_count) AS top_count FROM lineitem JOIN t USING (l_returnflag) GROUP BY l_returnflag"""
)
def sketches_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every ship date and flag, merged by flag: within their error bounds of exact figures, and frequent values exact."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_partkey", "l_extendedprice", "l_linenumber")
    daily = staged(S.summarised(rows, ["l_returnflag", "l_shipdate"], "l_partkey", "l_extendedprice", "l_linenumber"), "sketches")
    said = S.told(S.merged(daily, ["l_returnflag"]), k=1)
    below = [F.avg((F.col("l_extendedprice") <= F.col("quantiles")[i]).cast("double")) for i in range(3)]
    exact = rows.join(F.broadcast(said), "l_returnflag").groupBy("l_returnflag").agg(
        F.any_value("n").alias("n"), F.any_value("distinct").alias("distinct"), F.count_distinct("l_partkey").alias("parts"), F.any_value("top").alias("top"), F.array(*below).alias("ranks")
    )
    near = F.forall(F.arrays_zip("ranks", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)).alias("asked")), lambda r: F.abs(r["ranks"] - r["asked"]) <= S.RANK_ERROR)
    return exact.select(
        "l_returnflag", "n", (F.abs(F.col("distinct") - F.col("parts")) <= S.DISTINCT_ERROR * F.col("parts")).alias("distinct_ok"), near.alias("quantiles_ok"),
        F.col("top")[0]["item"].alias("top_value"), F.col("top")[0]["count"].alias("top_count"),
    )


@query("SELECT p_brand, p_type, CAST(floor(p_retailprice / 25) AS BIGINT) AS band, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'no such brand', p_type, NULL, 0 FROM part GROUP BY p_type")
def facet_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts have a brand, a type and a price band together, for every such selection, by AND of kept bitmaps."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.floor(F.col("p_retailprice") / 25).cast("long").alias("band"))
    bitmaps = staged(S.facet_bitmaps(S.numbered(part, "p_partkey"), ["p_brand", "p_type", "band"]), "bitmaps")
    every = part.select("p_brand", "p_type", "band").distinct().unionByName(part.select(F.lit("no such brand").alias("p_brand"), "p_type", F.lit(None).cast("long").alias("band")).distinct())
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in every.columns]))
    asked = every.select(F.struct(*every.columns).alias("selection"), named.alias("x")).select("selection", "x.*").filter("value is not null")
    return S.selected(bitmaps, asked).select("selection.*", "n")
