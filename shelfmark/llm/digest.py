"""Quartile bucket digests: locality-sensitive fingerprints of whole texts.

A window of five bytes slides over the UTF-8 text; each of the six byte triplets that hold its last
byte is hashed to one of 128 buckets.  The quartiles of the bucket counts turn every bucket into two
bits.  The digest is hexadecimal: a checksum byte, a length byte (logarithmic), a byte with the two
ratios of the quartiles, and 32 bytes of buckets.

``difference`` of two digests is the sum of bounded parts: up to 1 for the checksum, 24 each for
length and the two ratios, and 6 for each bucket that lies at the far quartile (1 or 2 for nearer
ones); ``likeness`` maps it to 0 .. 1, where 1 means equal digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, table

BUCKETS = 128
WINDOW = 5
#: Positions, back from the window's last byte, of the other two bytes of a triplet.
PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
BYTES_AT_ONCE = 1 << 18
#: Most that a header part and a bucket add to a difference.
HEAD_MOST, BUCKET_COST = 24, (0, 1, 2, 6)
MOST = 1 + 3 * HEAD_MOST + BUCKETS * BUCKET_COST[3]
#: Difference at which likeness is one half; unrelated prose of one language lies well beyond it.
HALF_AT = 110.0


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, list[np.ndarray]]:
    """A permutation of bytes (a multiplicative one, from a rule), and its start for each pair."""
    state, order = 0x9E3779B9, list(range(256))
    for i in range(255, 0, -1):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        j = (state >> 8) % (i + 1)
        order[i], order[j] = order[j], order[i]
    permutation = np.array(order, np.uint8)
    pairs = np.arange(1 << 16, dtype=np.uint32)
    tables = []
    for salt in range(len(PAIRS)):
        one = permutation[permutation[salt * 37 & 255] ^ (pairs >> 8).astype(np.uint8)]
        tables.append(permutation[one ^ (pairs & 255).astype(np.uint8)])
    return permutation, tables


def counts_of(data: bytes) -> np.ndarray:
    """Bucket counts of a text; a text shorter than the window is padded with zero bytes, an empty one has none."""
    permutation, tables = _mixers()
    total = np.zeros(BUCKETS, np.int64)
    if not data:
        return total
    padded = np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8)
    for at in range(0, len(padded) - WINDOW + 1, BYTES_AT_ONCE):
        some = padded[at : at + BYTES_AT_ONCE + WINDOW - 1]
        last, n = some[WINDOW - 1 :], len(some) - WINDOW + 1
        lag = [some[WINDOW - 1 - k : WINDOW - 1 - k + n] for k in range(WINDOW)]
        for (i, j), start in zip(PAIRS, tables, strict=True):
            pair = (last.astype(np.uint16) << 8) | lag[i]
            bucket = permutation[start[pair] ^ lag[j]] & 127
            total += np.bincount(bucket, minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    counts = counts_of(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.stack([codes >> 1, codes & 1], axis=1).astype(np.uint8).reshape(-1)).tobytes()
    size = min(255, round(12 * math.log1p(len(data)))) if data else 0
    ratios = (q1 * 100 // q3 % 16) << 4 | (q2 * 100 // q3 % 16) if q3 else 0
    check = hashlib.blake2b(data, digest_size=1).digest()
    return (check + bytes([size, ratios]) + body).hex()


def _ring(a: int, b: int, around: int) -> int:
    return min((a - b) % around, (b - a) % around)


def difference(one: str, other: str) -> int:
    """Bounded difference score of two digests, 0 .. ``MOST``."""
    a, b = bytes.fromhex(one), bytes.fromhex(other)
    score = int(a[0] != b[0]) + min(HEAD_MOST, abs(a[1] - b[1]))
    for shift in (4, 0):
        score += min(HEAD_MOST, 3 * _ring(a[2] >> shift & 15, b[2] >> shift & 15, 16))
    x, y = (np.unpackbits(np.frombuffer(d[3:], np.uint8)).reshape(-1, 2) @ np.array([2, 1], np.uint8) for d in (a, b))
    apart = np.abs(x.astype(np.int8) - y.astype(np.int8))
    return score + int(np.array(BUCKET_COST)[apart].sum())


def likeness(one: str, other: str) -> float:
    """1 for equal digests, one half at ``HALF_AT``, towards 0 beyond."""
    if one == other:
        return 1.0
    return 1.0 / (1.0 + (difference(one, other) / HALF_AT) ** 2)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


OUT = "kind string, part int, id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_FIELDS = [(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in OUT.split(", ")]


def _compared(key: int | None, text: str, own: str, following: str, other: str) -> tuple:
    changed = _bytes(edited(text, following))
    print_ = digest(changed)
    return ("row", None, key, len(text), hashlib.sha256(changed).hexdigest(), own, print_, likeness(own, print_), likeness(own, other), None)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each compared with the next; the first and last text are handed on."""
    schema = pa.schema(_FIELDS)
    out: list[tuple] = []
    before = part = None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for p, key, text in zip(*[batch.column(i) for i in range(3)], strict=True):
            part, key, text = p.as_py(), key.as_py(), text.as_py() or ""
            own = digest(_bytes(text))
            if before is None:
                out.append(("first", part, key, None, None, own, None, None, None, text))
            else:
                out.append(_compared(*before, text, own))
            before = (key, text, own)
            if len(out) >= 2000:
                yield flush()
                out = []
    if before is not None:
        out.append(("last", part, before[0], None, None, before[2], None, None, None, before[1]))
    if out:
        yield flush()


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FIELDS)
    for batch in batches:
        rows = [_compared(*r) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest every text, and compare it with its edited form and with the next text's digest.

    Texts are in order of descending id (null ids last; equal ids by the hash of the text); after
    the last comes the first.  The texts are range-partitioned once and each range is walked in
    order; only the two texts at the ends of each range meet in a second, small step.  Null texts
    are empty.  A single row follows itself; an empty table gives an empty result.  Texts are
    read whole, in bounded steps; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col("id").desc_nulls_last(), tie).sortWithinPartitions(F.col("id").desc_nulls_last(), tie)
    walked = materialise(ranged.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(_walk, OUT), "digests")
    ends = walked.filter("kind <> 'row'")
    names = ends.filter("kind = 'first'").select("part").sort("part").collect()  # one number for each range
    order = [r["part"] for r in names]
    follows = docs.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)) or [(-1, -1)], "part int, next int")
    last = ends.filter("kind = 'last'").select("part", "id", "text", "fingerprint").join(F.broadcast(follows), "part")
    first = ends.filter("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("then"), F.col("fingerprint").alias("then_print"))
    met = last.join(first, "next").select("id", "text", "fingerprint", "then", "then_print").mapInArrow(_join_ends, OUT)
    return walked.filter("kind = 'row'").unionByName(met).drop("kind", "part", "text")


def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
