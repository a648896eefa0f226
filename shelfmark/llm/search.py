"""Ranked lexical search over documents that recursive graph bisection has put in order.

**Order.**  Documents and hashed terms form a graph.  Level by level every part of the collection is
cut in two halves, and documents are exchanged between them as long as this shortens the gaps in the
lists of terms: the gain of a move follows from how many documents of either half have each term.
A pass counts these degrees, a second one counts gains by bin, and the driver, which sees nothing
but these two tables of bounded size, decides from which gain on documents change sides, as many
from the left as from the right.  What comes out together is a *shard*: few thousand documents at
most, numbered from 0 in the order of their ids.

**Index.**  A row for each shard: its terms, for each the numbers of the documents that have it with
its frequencies there, and the largest impact, that is what it adds to a score but for the term's weight.

**Search.**  A term's weight times its largest impact, summed over an item's terms, bounds what a
shard can hold.  Each item visits the shard with the highest bound, then those down to a level that
falls towards its tenth best score so far, until none is left whose bound reaches that score; ties
count, so a shard is left out only below it.  Then numbers are mapped back to document ids.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, table

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Terms are hashed to so many features; a document takes part in the bisection by so many of its most frequent ones
#: among those that at most this share of all documents has.  Rarer ones tell less: on sf0.1 sixteen parts are then of
#: one language to 0.94, by the rarest features of each document to 0.61.
FEATURES, MOST_FEATURES, MOST_SHARE = 8192, 24, 0.3
#: Parts are cut until they have about so many documents, or there are so many of them; larger ones are dealt by hash.
SHARD_DOCS, MOST_PARTS = 4096, 256
#: A shard has no more postings than about this either.
SHARD_POSTINGS = 4_000_000
EXCHANGES = 4
#: Gains by bin: so many bins, of so much each.
BINS, BIN_WIDTH = 129, 0.5
#: How far above its tenth best score an item still stops, round by round, as a share of the way to its highest bound.
DOWN_TO = (0.5, 0.2, 0.0)
#: So many items are scored together; a block of scores has as many rows.
ITEMS_TOGETHER = 512


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order; bytes are lowered in A-Z only."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


VECTOR = "row long, id long, n long, size long, terms string, tfs binary, buckets binary"
VECTORS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("terms", pa.string()), ("tfs", pa.binary()), ("buckets", pa.binary())])


def packed(counts: list[int]) -> bytes:
    """Counts in a byte each, or in four if one needs them; the length of the list tells which."""
    return bytes(counts) if max(counts, default=0) < 256 else np.array(counts, "<u4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else "<u4").astype(np.int64)


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            made = []
            for key, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                words = terms_of(text.as_py())
                row += 1
                if words:
                    counted = Counter(words)
                    buckets = np.unique(np.fromiter(map(zlib.crc32, counted), np.uint32, len(counted)) % FEATURES)
                    made.append((row, key, len(words), len(counted), b" ".join(counted), packed(list(counted.values())), buckets.astype("<u2").tobytes()))
            columns = list(zip(*made, strict=True)) if made else [[] for _ in VECTORS]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(pa.string()) if f.name == "terms" else pa.array(c, f.type) for c, f in zip(columns, VECTORS, strict=True)], schema=VECTORS)


def vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document with a term: ``row`` (a number of its own), ``id``, ``n`` terms, ``size`` distinct ones, and packed ``terms``, ``tfs``, ``buckets``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_vector_batches, VECTOR)


# --- Recursive graph bisection. ---
STATE = "row long, size long, features binary, part int, side int"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of packed lists, and where each list begins and the last ends."""
    lists = column.to_pylist()
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 2
    return np.frombuffer(b"".join(lists), "<u2").astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def _telling(df: np.ndarray, n_docs: int):
    """Batches of the first state: each document with its telling features, in one part."""
    good = (df > 1) & (df <= max(MOST_SHARE * n_docs, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, offsets = _lists(batch.column(2))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            found, owner = found[good[found]], owner[good[found]]
            order = np.lexsort((found, -df[found], owner))
            found, owner = found[order], owner[order]
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            first = np.arange(len(found)) - starts[owner] < MOST_FEATURES
            data = found[first].astype("<u2").tobytes()
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=batch.num_rows)))) * 2
            kept = pa.array([data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            zero = pa.array(np.zeros(batch.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, zero, zero], names=["row", "size", "features", "part", "side"])

    return run


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(FEATURES, np.int64)
    for batch in batches:
        counts += np.bincount(_lists(batch.column(0))[0], minlength=FEATURES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), pa.array(counts)], names=["b", "n"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Degrees of this task: documents by part, side and feature, and (as feature -1) all documents."""
    counts: Counter = Counter()
    for batch in batches:
        place = batch.column(1).to_numpy().astype(np.int64) * 2 + batch.column(2).to_numpy()
        features, offsets = _lists(batch.column(0))
        cells = np.concatenate((np.repeat(place, np.diff(offsets)) * (FEATURES + 1) + features + 1, place * (FEATURES + 1)))
        some, n = np.unique(cells, return_counts=True)
        counts.update(dict(zip(some.tolist(), n.tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["cell", "n"])


def degrees(state: DataFrame, parts: int) -> np.ndarray:
    """``[part, side, feature]`` counts; feature 0 counts all documents, others are shifted by one.  Bounded by parts and features."""
    found = state.select("features", "part", "side").mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(parts * 2 * (FEATURES + 1), np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(parts, 2, FEATURES + 1)


def move_gains(deg: np.ndarray) -> np.ndarray:
    """What moving a document from its side saves for each of its features, in bits: ``[part, side, feature]``."""
    n = np.maximum(deg[:, :, :1], 1).astype(np.float64)
    d = deg[:, :, 1:].astype(np.float64)

    def cost(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * np.log2(n[:, 0] / (left + 1)) + right * np.log2(n[:, 1] / (right + 1))

    now = cost(d[:, 0], d[:, 1])
    away = [now - cost(np.maximum(d[:, 0] - 1, 0), d[:, 1] + 1), now - cost(d[:, 0] + 1, np.maximum(d[:, 1] - 1, 0))]
    return np.stack(away, axis=1).astype(np.float32)


def signs(level: int) -> np.ndarray:
    """A sign for each feature, from a rule: the first cut of a part is along a random direction."""
    drawn = np.random.default_rng([level, FEATURES]).integers(0, 2, FEATURES)
    return (2 * drawn - 1).astype(np.float32)


def _bins(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values / BIN_WIDTH + 0.5).astype(np.int64) + BINS // 2, 0, BINS - 1)


def _values(batch: pa.RecordBatch, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part, side = batch.column("part").to_numpy().astype(np.int64), batch.column("side").to_numpy().astype(np.int64)
    features, offsets = _lists(batch.column("features"))
    lengths = np.diff(offsets)
    if tables.ndim == 1:
        return part, side, _sums(tables[features], offsets)
    return part, side, _sums(tables[np.repeat(part, lengths), np.repeat(side, lengths), features], offsets)


def _histogram(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            part, side, values = _values(batch, shared.value)
            some, n = np.unique((part * 2 + side) * BINS + _bins(values), return_counts=True)
            counts.update(dict(zip(some.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["cell", "n"])

    return run


def _moved(shared, chance: np.ndarray, salt: int):
    """Documents change sides with the chance of their part, side and bin; a hash of their row decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, side, values = _values(batch, shared.value)
            rows = batch.column("row").to_numpy().astype(np.uint64)
            drawn = ((rows + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
            drawn = (drawn ^ (drawn >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)
            changes = drawn.astype(np.float64) / float(1 << 53) < chance[part, side, _bins(values)]
            new = pa.array(np.where(changes, 1 - side, side).astype(np.int32))
            yield pa.RecordBatch.from_arrays([new if n == "side" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return run


def _counted(state: DataFrame, shared, parts: int) -> np.ndarray:
    found = state.mapInArrow(_histogram(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(parts * 2 * BINS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(parts, 2, BINS)


def halving(counts: np.ndarray) -> np.ndarray:
    """Chances to go to the right half so that each part is cut in the middle of its bins; all are on the left."""
    chance = np.zeros(counts.shape)
    left = counts[:, 0]
    above = left[:, ::-1].cumsum(axis=1)[:, ::-1] - left
    half = left.sum(axis=1, keepdims=True) / 2
    chance[:, 0] = np.clip((half - above) / np.maximum(left, 1), 0, 1)
    return chance


def exchange(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Chances to change sides, and how many do: pairs in order of gain, as long as two together gain.

    ``counts[part, side, bin]`` are documents by the gain of moving them.
    """
    chance, moved = np.zeros(counts.shape), 0
    worth = (np.arange(BINS) - BINS // 2) * BIN_WIDTH
    for p in range(len(counts)):
        at, left = [BINS - 1, BINS - 1], counts[p].astype(np.int64)
        taken = np.zeros((2, BINS), np.int64)
        while True:
            for s in (0, 1):
                while at[s] >= 0 and left[s, at[s]] == taken[s, at[s]]:
                    at[s] -= 1
            if min(at) < 0 or worth[at[0]] + worth[at[1]] <= 0:
                break
            n = min(left[s, at[s]] - taken[s, at[s]] for s in (0, 1))
            for s in (0, 1):
                taken[s, at[s]] += n
            moved += int(n)
        chance[p] = taken / np.maximum(left, 1)
    return chance, moved


def bisected(found: DataFrame, shard_docs: int, exchanges: int = EXCHANGES) -> tuple[DataFrame, int]:
    """``row``, ``size``, ``features``, ``part`` of the documents ``row``, ``size``, ``buckets``, and the number of parts."""
    spark = found.sparkSession
    met = found.select("buckets").mapInArrow(_bucket_counts, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # a row for each feature
    df = np.zeros(FEATURES, np.int64)
    df[met.column("b").to_numpy()] = met.column("n").to_numpy()
    n, parts, level = found.count(), 1, 0
    state = materialise(found.select("row", "size", "buckets").mapInArrow(_telling(df, n), STATE), "bisection")
    while parts < MOST_PARTS and n > parts * shard_docs:
        shared = spark.sparkContext.broadcast(signs(level))
        state = materialise(state.mapInArrow(_moved(shared, halving(_counted(state, shared, parts)), level), STATE), "bisection")
        for k in range(exchanges):
            deg = degrees(state, parts)
            shared = spark.sparkContext.broadcast(move_gains(deg))
            chance, moved = exchange(_counted(state, shared, parts))
            if moved * 200 < n:
                break
            # Half of the pairs, so that like documents do not all change places with each other.
            state = materialise(state.mapInArrow(_moved(shared, chance / 2 if k < exchanges - 1 else chance, 1000 * (level + 1) + k), STATE), "bisection")
        state = state.withColumn("part", F.col("part") * 2 + F.col("side")).withColumn("side", F.lit(0))
        parts, level = parts * 2, level + 1
    return state, parts


class Index(NamedTuple):
    """``shards``: a row each, packed; ``places``: ``shard``, ``number``, ``id`` of every document; and two totals."""

    shards: DataFrame
    places: DataFrame
    n_docs: int
    n_terms: int


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 10 + 90 * n * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


#: Lengths of the documents, the terms (joined by blanks) with how many documents each has, its largest impact, and one after the other the lists of all.
SHARD = "shard long, lengths binary, terms string, dfs binary, tops binary, numbers binary, tfs binary"
SHARDS = pa.schema([("shard", pa.int64()), ("lengths", pa.binary()), ("terms", pa.string()), ("dfs", pa.binary()), ("tops", pa.binary()), ("numbers", pa.binary()), ("tfs", pa.binary())])


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each group of sorted batches, as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _split(terms: str) -> pa.Array:
    return pc.split_pattern(pa.array([terms]), " ").flatten()


def _index_batches(n_docs: int, n_terms: int):
    """The row of each shard, from its documents in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _grouped(batches, "shard"):
            lengths, sizes = docs.column("n").to_numpy(), docs.column("size").to_pylist()
            encoded = _split(" ".join(docs.column("terms").to_pylist())).dictionary_encode()
            codes = encoded.indices.to_numpy()
            numbers = np.repeat(np.arange(len(sizes)), sizes)
            tfs = np.concatenate([unpacked(x, k) for x, k in zip(docs.column("tfs").to_pylist(), sizes, strict=True)])
            order = np.argsort(codes, kind="stable")
            df = np.bincount(codes, minlength=len(encoded.dictionary))
            tops = np.maximum.reduceat(impact(tfs, lengths[numbers], n_docs, n_terms)[order], np.cumsum(df) - df)
            row = (
                docs.column("shard")[0].as_py(), lengths.astype("<u4").tobytes(), " ".join(encoded.dictionary.to_pylist()), df.astype("<u4").tobytes(), tops.astype("<u4").tobytes(),
                numbers[order].astype(_width(len(sizes))).tobytes(), packed(tfs[order].tolist()),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SHARDS, strict=True)], schema=SHARDS)

    return run


def _width(n_docs: int) -> str:
    return "<u2" if n_docs <= 1 << 16 else "<u4"


def _top_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard and term."""
    for batch in batches:
        for shard, terms, dfs, tops in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words, df, top = _split(terms), np.frombuffer(dfs, "<u4").astype(np.int64), np.frombuffer(tops, "<u4").astype(np.int64)
            for at in range(0, len(words), 50_000):
                some = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df[some]), shard, np.int64)), words[some], pa.array(top[some]), pa.array(df[some])], names=["shard", "term", "top", "df"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    """An index of all documents with a term; texts are read whole."""
    prepare(docs.sparkSession)
    found = materialise(vectors(docs, id_col, text_col), "vectors")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    state, parts = bisected(found.select("row", "size", "buckets"), shard_docs)
    sizes = state.groupBy("part").agg(F.count("*").alias("docs"), F.sum("size").alias("postings")).collect()  # MOST_PARTS rows at most
    shares = {r["part"]: int(max(-(-r["docs"] // (shard_docs * 5 // 4)), -(-r["postings"] // SHARD_POSTINGS), 1)) for r in sizes}
    dealt = F.create_map(*[F.lit(x) for p, k in shares.items() for x in (p, k)]) if shares else F.create_map(F.lit(0), F.lit(1))
    shard = F.col("part").cast("long") * (1 << 32) + F.pmod(F.xxhash64("row"), F.element_at(dealt, F.col("part")))
    of_row = materialise(state.select("row", shard.alias("shard")), "shards")
    order = Window.partitionBy("shard").orderBy(F.col("id").asc_nulls_last(), "row")
    # Both sides are shuffled at every size: either grows with the documents.
    numbered = found.select("row", "id").hint("merge").join(of_row, "row").withColumn("number", F.row_number().over(order) - 1)
    places = materialise(numbered.select("row", "shard", "number", "id"), "places")
    rows = found.select("row", "n", "size", "terms", "tfs").hint("merge").join(places.select("row", "shard", "number"), "row").repartition("shard").sortWithinPartitions("shard", "number")
    shards = rows.select("shard", "n", "size", "terms", "tfs").mapInArrow(_index_batches(n_docs, n_terms), SHARD)
    return Index(materialise(shards, "shard-index"), places.drop("row"), n_docs, n_terms)


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted({t.decode("utf-8", "surrogatepass") for t in terms_of(x)}) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["item", "terms"])


def _score_batches(k: int, n_docs: int, n_terms: int):
    """The ``k`` best documents of a shard for each item of a block that visits it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
                lengths, df = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("lengths", "dfs"))
                ends = np.cumsum(df)
                numbers, tfs = np.frombuffer(row["numbers"], _width(len(lengths))), unpacked(row["tfs"], int(ends[-1]))
                needed = sorted({t["term"] for ask in row["asks"] for t in ask["terms"]})
                found = dict(zip(needed, pc.index_in(pa.array(needed, pa.string()), value_set=_split(row["terms"])).to_pylist(), strict=True))
                scores = np.zeros((len(row["asks"]), len(lengths)), np.int64)
                added: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for mine, ask in zip(scores, row["asks"], strict=True):
                    for term in ask["terms"]:
                        if (code := found[term["term"]]) is None:
                            continue
                        if code not in added:
                            some = slice(int(ends[code] - df[code]), int(ends[code]))
                            added[code] = numbers[some], impact(tfs[some], lengths[numbers[some]], n_docs, n_terms)
                        own, worth = added[code]
                        mine[own] += term["w"] * worth  # a document is in a list once
                out: list[list] = [[], [], []]
                for mine, ask in zip(scores, row["asks"], strict=True):
                    good = np.flatnonzero(mine > 0)
                    if len(good) > k:
                        least = np.partition(mine[good], len(good) - k)[len(good) - k]
                        good = np.concatenate((good[mine[good] > least], good[mine[good] == least][: k - int((mine[good] > least).sum())]))
                    for column, values in zip(out, ([ask["item"]] * len(good), good.tolist(), mine[good].tolist()), strict=True):
                        column.extend(values)
                shard = pa.array(np.full(len(out[0]), row["shard"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), shard, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=["item", "shard", "number", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "shard", "number")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, told: Callable[[int, int], None] | None = None) -> DataFrame:
    """``id`` of the item, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item, by score and then by ``doc_id``.

    Items without terms, or whose terms no document has, are not in the result; null item ids and
    repeated ones are answered row by row; null document ids come last among equal scores.  ``told``
    hears of each round how many visits it makes, and how many there could be.
    """
    spark = items.sparkSession
    prepare(spark)
    asked = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "items")
    said = materialise(asked.select("item", "text").mapInArrow(_item_batches, "item long, terms array<string>").select("item", F.explode("terms").alias("term")), "item-terms")
    # A row for each shard and term that some item names, without the lists.
    tops = index.shards.select("shard", "terms", "dfs", "tops").mapInArrow(_top_batches, "shard long, term string, top long, df long")
    heads = materialise(tops.join(said.select("term").distinct(), "term", "left_semi"), "heads")
    odds = (2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.sum("df") + 1).cast("double")
    weights = heads.groupBy("term").agg(F.floor(1000 * F.ln(odds)).cast("long").alias("w"))
    weighed = materialise(said.join(weights, "term").filter("w > 0").select("item", "term", "w"), "weights")
    questions = materialise(weighed.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "questions")
    bounds = weighed.join(heads.select("shard", "term", "top"), "term").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    open_ = materialise(bounds, "bounds")
    best = None
    for down_to in (None, *DOWN_TO):
        if down_to is None:
            level = open_.groupBy("item").agg(F.max(F.struct("bound", "shard")).alias("first"))
            visits = level.select("item", F.col("first.shard").alias("shard"))
        else:
            # The tenth score so far; with fewer documents any score is better.
            tenth = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(1)).alias("tenth"))
            high = open_.groupBy("item").agg(F.max("bound").alias("high")).join(tenth, "item", "left").withColumn("tenth", F.coalesce("tenth", F.lit(1)))
            level = high.select("item", "tenth", (F.col("tenth") + F.greatest(F.col("high") - F.col("tenth"), F.lit(0)) * down_to).alias("level"))
            open_ = materialise(open_.join(level, "item").filter("bound >= tenth").select("item", "shard", "bound", "level"), "bounds")
            visits = open_.filter("bound >= level").select("item", "shard")
            open_ = open_.select("item", "shard", "bound")
        visits = materialise(visits, "visits")
        if told is not None:
            told(visits.count(), open_.count())
        if visits.isEmpty():
            if best is None:
                break
            continue
        asks = visits.join(questions, "item").groupBy("shard", F.floor(F.col("item") / ITEMS_TOGETHER).alias("block")).agg(F.collect_list(F.struct("item", "terms")).alias("asks"))
        # Written, so that Spark knows its size: where it is small it goes to the shards, and these are not shuffled.
        asks = materialise(asks, "asks")
        met = index.shards.select("shard", "lengths", "terms", "dfs", "numbers", "tfs").join(asks.drop("block"), "shard")
        scored = materialise(met.mapInArrow(_score_batches(k, index.n_docs, index.n_terms), "item long, shard long, number int, score long"), "scored")
        found = scored.join(index.places, ["shard", "number"]).select("item", "shard", "number", "id", "score")
        found = found if best is None else found.unionByName(best)
        best = materialise(_best(found, k).drop("rank"), "best")
        open_ = open_.join(visits, ["item", "shard"], "left_anti")
    if best is None:
        best = spark.createDataFrame([], "item long, shard long, number int, id long, score long")
    ranked = _best(best, k).select("item", "rank", F.col("id").alias("doc_id"), "score")
    return ranked.join(asked.select("item", "id"), "item").select("id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "item_id")


_LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_LOWERED} AS xs FROM documents), x AS (SELECT doc_id, CAST(len(xs) AS BIGINT) AS n, unnest(xs) AS term FROM d WHERE len(xs) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(len(xs)) AS BIGINT) AS big_l FROM d WHERE len(xs) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_LOWERED}) AS term FROM benchmark)),
p AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, total GROUP BY term, big_n),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
