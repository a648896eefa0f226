"""Continuous ingestion: new pages through the extraction plan, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.plans.extract import extract
from shelfmark.sources.stages import scratch_scope

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Pages as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(pages: DataFrame, taxonomy: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write results of every batch under ``out/batch=<id>``.

    A batch that is repeated after a failure replaces its own folder, so each page's result is there
    once.  Extraction keeps no state between pages, and its stage tables go with their batch.
    """

    def handle(batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession):
            extract(batch, taxonomy).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen(pages: DataFrame, delay: str = "7 days") -> DataFrame:
    """Pages whose address was not seen within the delay; needs a ``seen_at`` timestamp."""
    return pages.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["url"])


def price_changes(results: DataFrame, earlier: DataFrame, key: str = "url") -> DataFrame:
    """Entries whose price differs from the one stored before: ``url``, ``before``, ``price``."""
    price = F.col("product.price.price")
    now, old = results.select(key, price.alias("price")).filter("price is not null"), earlier.select(key, price.alias("before"))
    return now.join(old, key).filter("price <> before")
