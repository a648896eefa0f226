"""Finished catalogs and taxonomies: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators.catalog import entry_id
from shelfmark.sources.stages import staged

PRICE = "struct<price: double, currency: string, compare_at_price: double>"
VARIANT = f"struct<sku: string, options: map<string, string>, price: {PRICE}, image_urls: array<string>, availability: string, gtin: string, mpn: string>"
PRODUCT = (
    f"struct<name: string, price: {PRICE}, description: string, key_features: array<string>, image_urls: array<string>, video_url: string, "
    f"category: struct<name: string>, brand: string, colors: array<string>, variants: array<{VARIANT}>, options: array<struct<name: string, values: array<string>>>>"
)
RESULT = f"product {PRODUCT}, url string, source string, confidence double, warnings array<string>, field_sources map<string, string>"


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``ord`` of a file with one path per line; blank lines and ``#`` comments are skipped."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return lines.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select(F.trim("line").alias("path"), "ord")


def taxonomy_of(paths: DataFrame, column: str) -> DataFrame:
    """``path``, ``ord`` of a table of paths, in their order, numbered range by range: no task sorts them all."""
    ranged = staged(paths.select(F.col(column).alias("path")).distinct().repartitionByRange("path").withColumn("range", F.spark_partition_id()), "taxonomy")
    # A row for each range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("path")) - 1
    return ranged.withColumn("i", within).join(F.broadcast(sums), "range").select("path", (F.col("before") + F.col("i")).cast("int").alias("ord"))


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Entries of written results, refusals left out; an absent path is an empty catalog."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = spark.createDataFrame([], RESULT)
    elif fmt == "json":
        rows = spark.read.schema(RESULT).option("multiLine", path.endswith(".json")).json(path)
    else:
        rows = spark.read.schema(RESULT).format(fmt).load(path)
    return entries(rows)


def entries(results: DataFrame) -> DataFrame:
    kept = results.filter("product is not null")
    return kept.select(entry_id(F.col("product.brand"), F.col("product.name"), F.col("source")).alias("id"), *kept.columns, F.col("product.brand").alias("brand"), F.col("product.category.name").alias("category"))


def write_results(results: DataFrame, path: str, mode: str = "deterministic", fmt: str = "json") -> str:
    """Write results beside others of their mode, never over the full run's; returns where."""
    out = f"{path.rstrip('/')}/products{'' if mode == 'full' else '.' + mode}"
    results.write.mode("overwrite").format(fmt).save(out)
    return out
