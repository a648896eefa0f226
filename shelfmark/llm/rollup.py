"""Token counts kept up to date by signed deltas.

A store is a folder of batches.  A batch is a table of changes (inserts, deletes, revised counts)
reduced to one signed row per source, language and tokenizer version, written under the batch's
name with a commit row.  Totals are the sum of all committed batches: they never need the documents
again, and batches commute.  Committing a name a second time changes nothing, whether the first
attempt ended or broke off: an uncommitted folder is replaced, a committed one is left.

:meth:`Rollup.compact` sums what was committed into a snapshot, so that totals read the latest
snapshot and the deltas committed after it, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, remove, scratch_path, table, words_in
from shelfmark.llm.tokens import default_tokenizer, encoder

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens", "n_chars")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS])


def inserted(counts: DataFrame) -> DataFrame:
    """Changes that add documents: ``counts`` has the keys, ``n_tokens`` and ``n_chars`` per document."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes that take documents away again, with the counts they were entered with."""
    return inserted(counts).select(*KEYS, *[(-F.col(c)).alias(c) for c in TOTALS])


def revised(counts: DataFrame, old: str = "old_tokens", new: str = "n_tokens") -> DataFrame:
    """Changes of counts: the documents stay, their tokens move by ``new - old``."""
    zero = F.lit(0).cast("long")
    return counts.select(*KEYS, zero.alias("n_docs"), (F.coalesce(F.col(new), zero) - F.coalesce(F.col(old), zero)).cast("long").alias("n_tokens"), zero.alias("n_chars"))


class Rollup:
    """A store of committed batches under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _complete(self, pattern: str) -> list[str]:
        """Names that stand for ``*`` in a pattern of folders which Spark has finished writing, by one listing."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        level = pattern.split("/").index("*")
        return sorted(f.getPath().toString().rsplit("/", 1)[0].split("/")[level - len(pattern.split("/"))] for f in found)

    def commit(self, name: str, *changes: DataFrame) -> bool:
        """Enter a batch; False, and nothing changed, if the name was committed before, whatever it holds now.

        The deltas are complete (Spark's ``_SUCCESS``) before the commit row is written, and only
        batches with a commit row count.
        """
        if not name or not all(c.isalnum() or c in "-_" for c in name):
            raise ValueError("a batch name has letters, digits, - and _ only")
        if self._exists(f"{self.path}/commits/{name}/_SUCCESS"):
            return False
        together = reduce(DataFrame.unionByName, changes)
        _sums(together).filter(" or ".join(f"{c} <> 0" for c in TOTALS)).write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        self.spark.range(1).select(F.lit(name).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")
        return True

    def batches(self) -> list[str]:
        return self._complete("commits/*")

    def _list(self, folder: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The latest complete snapshot and the batches that it took up itself."""
        done = self._complete("snapshots/*/taken")
        if not done:
            return None, set()
        taken = self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{done[-1]}/taken")
        return done[-1], {r.batch for r in taken.collect()}  # the batches of one compaction

    def _pending(self, taken: set[str]) -> list[str]:
        """Committed batches that no snapshot has: their deltas are still there and the latest did not take them."""
        return sorted(set(self._list("deltas")) & set(self.batches()) - taken)

    def compact(self) -> bool:
        """Sum the latest snapshot and the batches after it into a new one; False if there are none.

        The list of batches taken up is written last and makes the snapshot valid; only then are
        their deltas and the older snapshot removed.  What an attempt that broke off left is removed
        by the next.  One process compacts at a time; commit rows stay, so that names stay known.
        """
        last, taken = self._snapshot()
        remove(self.spark, *[f"{self.path}/deltas/{n}" for n in self._list("deltas") if n in taken])
        names = self._pending(taken)
        if not names:
            return False
        number = f"{int(last or 0) + 1:012d}"
        self.totals().write.mode("overwrite").parquet(f"{self.path}/snapshots/{number}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/{number}/taken")
        remove(self.spark, *[f"{self.path}/deltas/{n}" for n in names], *[f"{self.path}/snapshots/{n}" for n in self._list("snapshots") if n < number])
        return True

    def totals(self) -> DataFrame:
        """The sums over committed batches; keys whose totals are all zero are left out."""
        last, taken = self._snapshot()
        paths = [f"{self.path}/deltas/{n}" for n in self._pending(taken)] + ([f"{self.path}/snapshots/{last}/totals"] if last else [])
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        read = self.spark.read.schema(DELTA).parquet(*paths)
        return _sums(read).filter(" or ".join(f"{c} <> 0" for c in TOTALS))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            n = np.array([len(encode(t.as_py() or "")) for t in batch.column(batch.num_columns - 1)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``id``, ``source``, ``lang``, ``n_chars``, ``n_words``, ``n_tokens`` per row; null texts count 0.

    Null sources and languages are keys of their own.  Texts are read whole; repeated rows count
    each; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        F.length(text).cast("long").alias("n_chars"), words_in(text).alias("n_words"), text.alias("text"),
    )
    return rows.mapInArrow(_count_batches(tokenizer or default_tokenizer()), "id long, source string, lang string, n_chars long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two tokenizer versions, reached by five batches.

    Words and an estimate of tokens (a fourth of the characters) are entered first; the estimates
    are then revised to the exact counts and both summed into a snapshot; documents without a token are taken out and entered again,
    as they are documents of the corpus too; and the first batch arrives once more, which changes
    nothing.
    """
    counts = materialise(token_counts(table(spark, sf_dir, "documents")), "token-counts")
    words = counts.withColumn("tokenizer", F.lit("words-1")).withColumn("n_tokens", F.col("n_words"))
    exact = counts.withColumn("tokenizer", F.lit("byte-bpe-50k")).withColumn("old_tokens", F.ceil(F.col("n_chars") / 4))
    guess = exact.withColumn("n_tokens", F.col("old_tokens"))
    store = Rollup(spark, scratch_path(spark, "rollup"))
    store.commit("load", inserted(words), inserted(guess))
    store.commit("exact", revised(exact))
    store.compact()
    empty = words.filter("n_tokens = 0"), exact.filter("n_tokens = 0")
    store.commit("empty", *map(deleted, empty))
    store.commit("empty-again", *map(inserted, empty))
    store.commit("load", inserted(words), inserted(guess))
    return store.totals()
