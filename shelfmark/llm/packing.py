"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents longer than a sequence are cut into full pieces, the first piece being the shorter rest.
What is packed then depends on lengths alone, of which there are at most ``max_tokens``: the driver
gets one count per length and runs best-fit decreasing over counts, moving whole groups of equally
filled sequences at a time.  The plan has a few thousand rows whatever the corpus holds; each says
that ranks ``lo .. hi`` among the pieces of one length go to consecutive places.  Pieces are ranked
within their length by a two-level count, so that no length is sorted in one task, and take their
places by a join.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, table
from shelfmark.llm.tokens import default_tokenizer, encoder

MAX_TOKENS = 2048
#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 20_000


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` ids: the rest first, then full ones."""
    rest = n % most
    starts = ([(0, rest)] if rest else []) + [(i, most) for i in range(rest, n, most)]
    return starts


def _piece_batches(path: str, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), most)):
                    out.append((key, k, start, length, ids[start : start + length].tobytes()))
                    held += 4 * length
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit) per piece.

    A null text counts as empty and is the single id ``end_id``; every row of ``docs`` gives at
    least one piece.  Texts are cut whole, however long; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_piece_batches(tokenizer or default_tokenizer(), max_tokens, end_id), "id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` of lengths: rows ``(length, lo, hi, first, per, offset)``.

    Rank ``r`` (``lo <= r < hi``) of ``length`` goes to sequence ``first + (r - lo) // per`` at
    ``offset + (r - lo) % per * length``.  Each row empties a length or a group of equally filled
    sequences or leaves one group half used, so there are at most a few rows per length.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    open_groups: dict[int, list[tuple[int, int]]] = {}  # by room left: first sequence, how many
    rooms: list[int] = []
    made = 0

    def put(room: int, first: int, many: int) -> None:
        if room <= 0 or many <= 0:
            return
        if room not in open_groups:
            insort(rooms, room)
            open_groups[room] = []
        open_groups[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room], rooms[at]
            else:
                room, first, many = size, made, math.ceil(left / (size // length))
                made += many
            per = room // length
            full = min(many, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, per, size - room))
                rank, left = rank + full * per, left - full * per
                put(room - per * length, first, full)
            rest = left if full < many else 0
            if rest:
                rows.append((length, rank, rank + rest, first + full, rest, size - room))
                rank, left = rank + rest, 0
                put(room - rest * length, first + full, 1)
                full += 1
            put(room, first + full, many - full)
    return rows


def place(parts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``parts`` needs ``id``, ``piece``, ``length``.

    ``parts`` is read twice and should be a table, not a computation.  Other columns are kept,
    whatever their names, but for older ``sequence_id`` and ``offset``, which are replaced.  Equal
    pieces (repeated rows) take different places; null ids are like any other.  An empty table gives
    an empty result.
    """
    spark = parts.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length, max_tokens at most
    rows = plan(counts, max_tokens)
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, first long, per long, at long")
    if len(rows) <= 8 * max_tokens:
        places = F.broadcast(places)
    shares = spark.createDataFrame([(n, math.ceil(c / RANKED_TOGETHER)) for n, c in counts.items()] or [(0, 1)], "length long, shares int")
    kept = [c for c in parts.columns if c.lower() not in ("sequence_id", "offset")]
    wrapped = parts.select(F.col("id"), F.col("piece"), F.col("length").cast("long").alias("length"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    # Rows that repeat an id, or have none, are dealt by all they hold.
    salted = wrapped.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("id", "piece", *[F.col(f"row.`{c}`") for c, kind in parts.select(*[F.col(f"`{c}`") for c in kept]).dtypes if "map<" not in kind]), F.col("shares")).cast("int")).drop("shares")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("before"))
    fits = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    step = F.col("rank") - F.col("lo")
    sequence, offset = F.col("first") + F.floor(step / F.col("per")), F.col("at") + step % F.col("per") * ranked["length"]
    return ranked.join(places, fits).select("row.*", sequence.alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences."""
    return place(materialise(pieces(docs, id_col, text_col, max_tokens, tokenizer, end_id), "pieces"), max_tokens)


def packed_digests(docs: DataFrame) -> DataFrame:
    """The packing of ``docs`` with a checksum in place of the ids, which then need not be shuffled."""
    parts = materialise(pieces(docs), "pieces")
    narrow = parts.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(narrow).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))
