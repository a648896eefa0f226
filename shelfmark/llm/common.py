"""Plumbing shared by the corpus operators: scratch tables, readers, worker imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.stages import new_path as scratch_path
from shelfmark.sources.stages import remove, scratch_scope, ship_package, write_stage
from shelfmark.sources.stages import staged as materialise

__all__ = ["bound_batches", "free_name", "materialise", "prepare", "remove", "scratch_path", "scratch_scope", "ship_package", "table", "words_in", "write_stage"]

ARROW_DEFAULT, ARROW_BYTES = str(64 << 20), str(16 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of 16 MiB, unless the session names a size itself.

    A worker holds a batch, its Python strings and what it makes of them at the same time.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == ARROW_DEFAULT:
        spark.conf.set(key, ARROW_BYTES)


def prepare(spark: SparkSession) -> None:
    """What every operator with a Python step needs before it: the package at the workers, bounded batches."""
    ship_package(spark)
    bound_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: F.Column) -> F.Column:
    """How many runs of characters other than ASCII white space a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or with underscores before it until no column in ``taken`` has that name."""
    lowered = {c.lower() for c in taken}
    while wanted.lower() in lowered:
        wanted = "_" + wanted
    return wanted
