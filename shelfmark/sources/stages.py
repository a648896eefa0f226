"""Cutting long plans into stages: tables in the shared folder, and the package at the workers."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Paths of tables not yet removed: of no scope, and of the scopes that the thread at hand has open, innermost last.
_LOOSE: list[str] = []
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scopes", default=())
#: The open scopes of all threads.
_ALL: list[list[str]] = [_LOOSE]
_SHIPPED: set[tuple[str, str]] = set()
#: Names of the tables in buckets, by path.
_TABLES: dict[str, str] = {}

#: Rows of a bucket where there are many, and at least where there are few.
BUCKET_ROWS, LEAST_ROWS = 4000, 250
#: While a table in buckets is written, what is joined or grouped by its key (and more) stays in the bucket.
IN_PLACE = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    # What a condition asks more than once is else computed before it, for rows too that its first part passes over.
    "spark.sql.subexpressionElimination.skipForShortcutExpr": "true",
    # A list that is made to be exploded would be made twice, first to ask whether it is empty.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only where none is named."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="shelfmark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no run has used; removed with the scope that is open now."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (_OPEN.get() or (_LOOSE,))[-1].append(path)
    return path


def write_stage(df: DataFrame, label: str) -> str:
    """Write ``df`` under a new path and return that."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and its plan forgotten.

    A Python step then runs once however many readers it has, and a lost executor costs no more than
    its part of the stage at hand.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, label))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """How many buckets for so many rows: some for each core, none of them large."""
    return max(1, -(-rows // BUCKET_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


def bucketed(df: DataFrame, label: str, buckets: int, key: str = "page_id", placed: bool = False, within: tuple[str, ...] = (), divided: str | None = None) -> DataFrame:
    """:func:`staged` in ``buckets`` files, by the hash of ``key`` and in its order, of equal keys in that of ``within``.

    Tables of equal buckets are joined and grouped by their key without a shuffle, and tasks are as
    many as buckets however small a table is in its file.  ``placed`` says that the partitions of
    ``df`` are those of the buckets already, though Spark does not know.  ``divided`` names a column
    whose values lie in folders of their own, each in buckets: one pass then writes several tables.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = _TABLES[path] = f"shelfmark_{path.rsplit('-', 1)[1]}"
    with _settings(spark, IN_PLACE):
        rows = df if placed else df.repartition(buckets, key)
        out = rows.write.format("parquet") if divided is None else rows.write.format("parquet").partitionBy(divided)
        out.bucketBy(buckets, key).sortBy(key, *within).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def kept(df: DataFrame, label: str, buckets: int | None, *within: str) -> DataFrame:
    """A stage table, in buckets of ``page_id`` if a number of them is given, and there in the order of ``within``.

    A join by the page and that number then sorts the other side alone.
    """
    return staged(df, label) if buckets is None else bucketed(df, label, buckets, within=within)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str, buckets: int | None) -> DataFrame:
    """:func:`kept` of what ``make`` gives; the tables that it wrote on the way are removed when that is written."""
    with scratch_scope(spark) as own:
        made = kept(make(), label, buckets)
        path = own.pop()  # written last
    (_OPEN.get() or (_LOOSE,))[-1].append(path)
    return made


def reused(df: DataFrame, label: str, buckets: int | None) -> DataFrame:
    """What a plan reads more than once, in buckets if a number of them is given: it is computed anew for each use otherwise.

    Without a shuffle there is none to reuse, and a union forgets in which buckets its parts are.
    """
    return df if buckets is None else bucketed(df, label, buckets)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stage tables that nothing will read any more."""
    for path in paths:
        if name := _TABLES.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        for scope in (*_OPEN.get(), _LOOSE):
            if path in scope:
                scope.remove(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Stage tables made inside by this thread are removed at the end, also after an error.

    Results are computed when they are read: write or collect them inside.
    """
    own: list[str] = []
    _ALL.append(own)
    before = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    finally:
        remove(spark, *list(own))
        _OPEN.reset(before)
        _ALL[:] = [scope for scope in _ALL if scope is not own]


@atexit.register
def _remove_rest() -> None:
    """What no scope removed goes with the interpreter, if the session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, *[p for scope in list(_ALL) for p in list(scope)])


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package although only the driver has it: as an archive, once a session's context."""
    root = Path(__file__).resolve().parents[1]
    files = sorted(p for p in root.rglob("*.py"))
    digest = hashlib.sha256()
    for p in files:
        digest.update(f"{p.relative_to(root)}\n".encode() + p.read_bytes())
    key = (spark.sparkContext.applicationId, digest.hexdigest())
    if key in _SHIPPED:
        return
    # Spark's own file server hands the archive out; no worker reads this folder.
    folder = tempfile.mkdtemp(prefix="shelfmark-archive-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{root.name}-{digest.hexdigest()[:16]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in files:
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(key)
