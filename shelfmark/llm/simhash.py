"""SimHash near-duplicate components, with candidates found by fuzzy hashing on the Golay code.

A 64-bit fingerprint is cut into ``segments`` parts.  Two fingerprints that differ in at most
three bits agree wholly in ``segments - 3`` of them, whichever those are; the at most three errors
lie in the other three parts, which are halved, and one half has at most one error.  That half (at
most 24 bits, of which the first 23 count) is decoded with the perfect binary [23, 12, 7] Golay
code: flipping each bit of a word in turn and decoding gives one codeword if the word is within
two bits of it and six otherwise, and the codeword of any word one bit away is among them.  So
each fingerprint is filed under its own codeword and looked up under all its nearby ones, together
with the parts that must agree.  Nothing within three bits is missed (tests/llm hold this against
all pairs); every candidate is verified by counting the differing bits in the join.

With four segments (default) a key has 28 bits, 8 rows to file and at most 48 to look up.  Five
segments give 38 bits and 20 / 120 rows, for corpora of many billions of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import free_name, materialise, prepare, table
from shelfmark.llm.components import connected_components

MAX_BITS = 3
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_GENERATOR = 0b110001110101
SEED = 42


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash over three-word shingles; 0 for a text without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is just what is wanted: A-Z are
    lowered, and words end at U+0020 and U+0009 to U+000D.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-3]))
        shingles = [joined[i:j] for i, j in zip(starts.tolist(), (ends[2:] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        some = b"".join([digest(s, SEED) for s in shingles[at : at + 65536]])
        counts += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a signed long) per row; a null text counts as empty."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_batches, "id long, fp long")


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of the upper 12 and lower 11 bits of a word, and the error pattern of each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(w << 11) for w in range(1 << 12)], np.int64)
    lower = np.arange(1 << 11, dtype=np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            errors[upper[word >> 11] ^ lower[word & 0x7FF]] = word
    return upper, lower, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word; it is within three bits."""
    upper, lower, errors = _syndromes()
    return (words ^ errors[upper[words >> 11] ^ lower[words & 0x7FF]]) >> 11


def nearby(words: np.ndarray) -> np.ndarray:
    """A row for each word: the codeword indices of all words within one bit; sorted, repeats as -1."""
    flips = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _bits(prints: np.ndarray, low: int, high: int) -> np.ndarray:
    return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def keys_of(prints: np.ndarray, segments: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``prints`` and keys: of the own codeword, or (``wide``) of all nearby ones."""
    edges = np.linspace(0, 64, segments + 1).round().astype(int)
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    rows, keys, kind = [], [], 0
    for same in combinations(range(segments), segments - MAX_BITS):
        exact = np.zeros(len(prints), np.uint64)
        for s in same:
            exact = exact << np.uint64(parts[s][1] - parts[s][0]) | _bits(prints, *parts[s])
        rest, width = np.zeros(len(prints), np.uint64), 0
        for s in range(segments):
            if s not in same:
                rest = rest << np.uint64(parts[s][1] - parts[s][0]) | _bits(prints, *parts[s])
                width += parts[s][1] - parts[s][0]
        half = width // 2
        for low, high in ((0, half), (half, width)):
            word = _bits(rest, low, min(high, low + 23)).astype(np.int64)
            near = nearby(word) if wide else decode(word)[:, None]
            at, which = np.nonzero(near >= 0)
            tail = exact[at] << np.uint64(12) | near[at, which].astype(np.uint64)
            rows.append(at)
            keys.append(tail | np.uint64(kind) << np.uint64(58))
            kind += 1
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _key_batches(segments: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(signed), 4096):
                some = signed[at : at + 4096]
                rows, keys = keys_of(some.view(np.uint64), segments, wide)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], names=["key", "fp"])

    return run


def linked_pairs(prints: DataFrame, segments: int = 4) -> DataFrame:
    """All pairs ``a < b`` of the distinct fingerprints ``fp`` that differ in 1 to 3 bits.

    Spark takes a Python step to give as many rows as it reads, so that the keys of a small table look small
    enough to broadcast; they are up to 48 times as many and always meet by shuffle.
    """
    if not 4 <= segments <= 5:
        raise ValueError("a key holds 4 or 5 segments")
    filed = prints.mapInArrow(_key_batches(segments, False), "key long, fp long").select("key", F.col("fp").alias("a"))
    sought = prints.mapInArrow(_key_batches(segments, True), "key long, fp long").select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return filed.join(sought.hint("merge"), (filed["key"] == sought["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = 4) -> DataFrame:
    """``id``, ``fp``, ``component_id`` per row of ``docs``.

    Texts link if their fingerprints differ in at most three bits; ``component_id`` is the smallest
    id reachable over links.  Null and word-free texts have fingerprint 0 and link like others.
    Rows that repeat an id are all returned; null ids are ignored in the minimum, and a component
    of null ids alone has a null ``component_id``.  Copies are linked through their common
    fingerprint and never paired.  Texts are read whole; other columns are ignored; an empty table
    gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(linked_pairs(distinct.select("fp"), segments))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(names, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the row with the smallest id.

    Rows without an id are kept, as nothing names them; of rows that repeat the smallest id one
    stays.  Other columns are kept, whatever their names; an empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col).filter("id is not null")
    named = found.groupBy("id").agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    # Only ids that go or recur are joined to the texts, once.
    marks = materialise(named.filter("id <> component or n > 1"), "simhash-marks")
    id_name, component, n = (free_name(c, docs.columns) for c in ("dup_id", "dup_component", "dup_n"))
    marked = docs.join(marks.toDF(id_name, component, n), docs[id_col] == F.col(id_name), "left")
    alone = marked.filter(F.col(id_name).isNull())
    repeated = marked.filter(F.col(id_name) == F.col(component)).dropDuplicates([id_name])
    return alone.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
