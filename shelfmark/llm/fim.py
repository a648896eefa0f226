"""Fill-in-middle: documents cut in three at seeded token boundaries and put together in another order.

Documents with the same text share one entry of an index of distinct texts.  One pass over the
documents names each text by its SHA-256 and sends on a small row per document, and the text itself
only once per task and group, so that copies are combined before the shuffle.  Where the entry of a
text is made, all bytes sent for it are compared with the first ones (equal names of different texts
are an error, not a mix), its token boundaries are found once and kept as an Elias-Fano list, and
the documents that come after it, joined to it by name, select their two cuts from that list.

A text that a task has met :data:`TOGETHER` times is hot: its further copies form groups of their
own, so many in each, with one more copy of the text for each group.  No task therefore gets more
documents of one text than :data:`TOGETHER` times the number of tasks before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import prepare, table

#: Markers before prefix, suffix and middle; a text that holds one of them is not cut.
MARKERS = ("<P>", "<S>", "<M>")
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
#: So many copies of a text in one task are one group.
TOGETHER = 64
BYTES_AT_ONCE = 1 << 20
SELECT_BLOCK = 64
OUT_BYTES = 8 << 20


class EliasFano:
    """An ascending list of numbers up to ``universe``: the low bits as they are, the high bits in unary; :meth:`select` reads one."""

    def __init__(self, values: np.ndarray, universe: int) -> None:
        self.n = len(values)
        self.low_bits = max(0, (universe // self.n).bit_length() - 1) if self.n else 0
        values = values.astype(np.int64)
        low = values & ((1 << self.low_bits) - 1)
        shifts = np.arange(self.low_bits - 1, -1, -1, dtype=np.int64)
        self.low = np.packbits((low[:, None] >> shifts & 1).astype(np.uint8)) if self.low_bits else np.zeros(0, np.uint8)
        ones = (values >> self.low_bits) + np.arange(self.n)
        unary = np.zeros(int(ones[-1]) + 1 if self.n else 0, np.uint8)
        unary[ones] = 1
        self.high = np.packbits(unary)
        counts = np.bitwise_count(self.high).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(np.add.reduceat(counts, np.arange(0, len(counts), SELECT_BLOCK))))) if len(counts) else np.zeros(1, np.int64)

    def select(self, i: int) -> int:
        """The number at position ``i``, from one block of the high bits and the low bits at that position."""
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * SELECT_BLOCK : (block + 1) * SELECT_BLOCK])
        one = block * SELECT_BLOCK * 8 + int(np.flatnonzero(bits)[i - int(self.before[block])])
        low = 0
        if self.low_bits:
            at = i * self.low_bits
            some = np.unpackbits(self.low[at >> 3 : (at + self.low_bits + 7) >> 3])[at & 7 :][: self.low_bits]
            low = int("".join(map(str, some.tolist())), 2)
        return (one - i) << self.low_bits | low

    @property
    def size(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.before.nbytes


def token_ends(data: bytes) -> np.ndarray:
    """Where the tokens of a UTF-8 text end: after each word, and at the end after trailing white space."""
    found = []
    for at in range(0, len(data), BYTES_AT_ONCE):
        some = np.frombuffer(data, np.uint8, min(BYTES_AT_ONCE + 1, len(data) - at), at)
        space = (some == 0x20) | ((some >= 0x09) & (some <= 0x0D))
        if at + BYTES_AT_ONCE >= len(data):
            space = np.append(space, True)
        found.append(np.flatnonzero(~space[:-1] & space[1:]) + at + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    if data and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return ends


class Text:
    """An entry of the index: the bytes of a text and its boundaries."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.ends = EliasFano(token_ends(data), len(data))
        self.whole = not data or any(m.encode() in data for m in MARKERS)

    def end_of(self, units: int) -> int:
        return self.ends.select(units - 1) if units else 0


def _code_points(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def cut(text: Text, key: int | None, seed: int = SEED) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle (null for a plain one), and output of one document."""
    hashed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hashed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if text.whole or h[2] % 100 >= CUT_PERCENT:
        return "plain", None, None, text.data
    first, second = (text.end_of(units) for units in sorted(x % (text.ends.n + 1) for x in h[:2]))
    prefix, middle, suffix = text.data[:first], text.data[first:second], text.data[second:]
    p, s, m = (marker.encode() for marker in MARKERS)
    form = "spm" if h[3] % 100 < SPM_PERCENT else "psm"
    made = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return form, _code_points(prefix), _code_points(middle), b"".join(made)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    parts = F.split(output, "|".join(MARKERS))
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


_SENT = pa.schema([("name", pa.binary()), ("share", pa.int64()), ("member", pa.bool_()), ("id", pa.int64()), ("data", pa.binary())])
_MADE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and the text before the first of each group of this task."""
    task = TaskContext.get().partitionId()
    met: dict[bytes, int] = {}
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            name = hashlib.sha256(data).digest()
            before = met.get(name, 0)
            met[name] = before + 1
            # All tasks share the first group of a text; those of a hot text belong to the task.
            share = 0 if before < TOGETHER else task << 32 | before // TOGETHER
            if before % TOGETHER == 0:
                rows.append((name, share, False, None, data))
            rows.append((name, share, True, key, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)] if rows else [pa.array([], f.type) for f in _SENT], schema=_SENT)


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in order, each with its text before its documents: entries are made, verified and used."""
    name = text = None
    out: list[tuple] = []
    size = 0
    for batch in batches:
        for at, (here, member, key) in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True)):
            if member:
                made = cut(text, key)
                out.append((key, text.ends.n, *made[:3], made[3].decode("utf-8", "surrogatepass")))
                size += len(made[3])
                if size >= OUT_BYTES or len(out) >= 10_000:
                    yield _rows(out)
                    out, size = [], 0
                continue
            data = batch.column(4)[at].as_py()
            if here != name:
                name, text = here, Text(data)
            elif data != text.data:
                raise ValueError(f"two texts have the SHA-256 {name.hex()}")
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MADE, strict=True)], schema=_MADE)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` per row of ``docs``.

    Texts are cut whole, between any of their ``n`` tokens.  Null texts are empty; empty texts and
    those with a marker stay plain.  The seed of a null id is that of an empty one; rows that repeat
    an id and a text are returned each, cut alike.  Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(_send, "name binary, share long, member boolean, id long, data binary")
    grouped = sent.repartition("name", "share").sortWithinPartitions("name", "share", "member")
    return grouped.mapInArrow(_make, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


_SPACE = r"[\x20\x09-\x0D]"
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}*[^\x20\x09-\x0D]+|{_SPACE}+') AS xs, sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), seeded AS (
  SELECT *, CAST(len(xs) AS BIGINT) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM cut
), formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM seeded
), parts AS (
  SELECT *, array_to_string(list_slice(xs, 1, a), '') AS p, array_to_string(list_slice(xs, a + 1, b), '') AS m, array_to_string(list_slice(xs, b + 1, n), '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
