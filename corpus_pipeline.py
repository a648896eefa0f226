"""A training corpus from ``documents``: toxic texts out, near duplicates out, mixed, packed.

Each stage takes all rows that the one before it kept, written as Parquet in between.  Every stage
passes an empty table on, reads texts whole and keeps all columns of documents but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import mixing, packing, simhash, toxicity
from shelfmark.llm.common import prepare, remove, scratch_path, scratch_scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the severity model, fitted on ``labels``, rejects go.

    Null and empty texts stay, repeated rows are judged alike, and without labels all stay.
    """
    prepare(spark)
    return toxicity.clean_only(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near duplicates the document with the smallest id stays.

    Texts without words are near duplicates of each other; rows without an id stay; of rows that
    repeat an id one stays.
    """
    prepare(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix to target weights takes it, longer ones more often.

    Texts without words go, as they add to no target; a null source is a source.
    """
    prepare(spark)
    return mixing.repeated(docs, weight=mixing.longer_more)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of the documents and their places in sequences of 2048 tokens.

    Each of several copies of a document takes places of its own.
    """
    prepare(spark)
    return packing.packed_digests(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: A fitted model, a fuzzy-hash join and a tokenizer are beyond SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's own tables, and what it read, go when its result is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = path
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove(spark, before)
    return docs
