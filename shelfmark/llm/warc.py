"""WARC archives: a writer of one gzip member per record, and a sequential reader.

Writing.  Records become gzip members in an Arrow stage and Spark's own writer puts them into
files, so that archives land in any store Spark reaches and a task that is lost is written anew.
Spark's text sink ends every row with a separator; a gzip member ends with the high byte of its
length, which is zero below 16 MiB, so members are handed over without that byte and the separator
is a zero byte.  A longer member keeps its last byte, and the zero after it is padding, which gzip
readers skip.  A row of that sink is a whole archive, closed at a number of bytes or of records.

Reading.  Archives are read whole by Spark (the writer bounds their bytes) and walked
sequentially: members are inflated in small steps, headers parsed, the block framed by
Content-Length, the member's end demanded after it, and block and payload digests verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, scratch_path, table

STEP = 1 << 16
LEAST_REVISIT = 1000
#: Size at which an archive is closed.
ARCHIVE_BYTES = 64 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: the WARC 1.1 profile of revisits by payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1f3a52-0d7c-5b0e-9c39-0c6a53a7c7d1")
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks off, is framed wrongly or fails a digest."""


def record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}|{digest}')}>"


def digest_of(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()


def _matches(said: str, block: bytes) -> bool:
    """Whether a digest header fits; one by an algorithm that is not known here is not judged."""
    name, _, value = said.partition(":")
    name = name.lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return True
    raw = hashlib.new(name, block, usedforsecurity=False).digest()
    return value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex()


def _sha1_hex(said: str | None) -> str | None:
    """A SHA-1 digest header as bare hexadecimal; null for other algorithms."""
    name, _, value = (said or "").partition(":")
    if name.lower().replace("-", "") != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _headers(raw: bytes) -> dict[str, str]:
    try:
        lines = raw.decode("utf-8").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    except UnicodeDecodeError as error:
        raise WarcError("a header that is not UTF-8") from error
    if not lines[0].startswith("WARC/"):
        raise WarcError("no WARC version line")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not headers.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    return headers


def _uri(url: str | None, key: object) -> str:
    if not url:
        return f"urn:page:{key}"
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def write_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member; a revisit holds the HTTP head only and names the record it repeats."""
    digest = digest_of(payload)
    block = HTTP_HEAD if is_revisit else HTTP_HEAD + payload
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, key)),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", digest_of(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if key is not None:
        head.append(("X-Row-Key", str(key)))
    if is_revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Key", str(refers_to))]
    record = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and payload of each record, in order; raises :class:`WarcError`."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        if view[at] == 0:  # padding between members
            at += 1
            continue
        inflate, buffer, need, headers = zlib.decompressobj(31), bytearray(), None, {}
        while not inflate.eof:
            if at >= len(view):
                raise WarcError("the archive ends inside a record")
            step = view[at : at + STEP]
            at += len(step)
            try:
                buffer += inflate.decompress(step)
            except zlib.error as error:
                raise WarcError(f"not a gzip member: {error}") from error
            if need is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
                headers = _headers(bytes(buffer[:end]))
                del buffer[: end + 4]
                need = int(headers["content-length"])
            if need is not None and len(buffer) > need + 4:
                raise WarcError("a record is longer than its Content-Length")
        at -= len(inflate.unused_data)
        if need is None or len(buffer) != need + 4 or buffer[need:] != b"\r\n\r\n":
            raise WarcError("a record does not end where its Content-Length says")
        block = bytes(buffer[:need])
        if (said := headers.get("warc-block-digest")) and not _matches(said, block):
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        if headers.get("warc-type") != "revisit" and (said := headers.get("warc-payload-digest")) and not _matches(said, payload):
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        yield headers, payload


def _write_batches(archive_bytes: int, records: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Archives as rows: members one after another, without the last byte where that is zero."""

    def closed(members: list[bytes]) -> pa.RecordBatch:
        if members[-1][-1] == 0:
            members[-1] = members[-1][:-1]
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["member"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = [], 0
        for member in _members(batches):
            members.append(member)
            held += len(member)
            if held >= archive_bytes or len(members) >= records:
                yield closed(members)
                members, held = [], 0
        if members:
            yield closed(members)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for key, url, payload, refers_to, is_revisit in zip(*[batch.column(i) for i in range(5)], strict=True):
            yield write_record(key.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py(), is_revisit.as_py())


def choose_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """``key``, ``url``, ``payload`` (bytes), ``refers_to``, ``is_revisit`` for each row of ``pages``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest key is
    the response.  Rows repeating that key are responses too; rows without a key never are one for
    others, and are responses themselves if no row of the group has a key.  Null payloads are empty.
    Payloads are taken whole, however long; other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("same", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    # Only digests and keys are shuffled here, combined before; payloads met once stay where they are
    # if the table of repeated ones is small enough to be sent to them.
    first = rows.filter("same is not null").groupBy("same").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    first = materialise(first, "warc-first")
    found = rows.join(first, "same", "left")
    is_revisit = F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to"))
    return found.select("key", "url", "payload", F.when(is_revisit, F.col("refers_to")).alias("refers_to"), is_revisit.alias("is_revisit"))


def write(rows: DataFrame, path: str, records_per_file: int = 4096, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows of :func:`choose_revisits` as archives under ``path``.

    An archive is closed once it has ``archive_bytes`` or ``records_per_file``, so that it is larger
    than ``archive_bytes`` by less than one record.
    """
    prepare(rows.sparkSession)
    members = rows.select("key", "url", "payload", "refers_to", "is_revisit").mapInArrow(_write_batches(archive_bytes, records_per_file), "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


READ_SCHEMA = "key long, record_type string, record_id string, url string, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary"


def _read_batches(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for headers, payload in read_records(archive.as_buffer()):
                    kind = headers.get("warc-type")
                    own = kind != "revisit"
                    raw = _sha1_hex(headers.get("warc-payload-digest")) or (hashlib.sha1(payload, usedforsecurity=False).hexdigest() if own else None)
                    key, other = headers.get("x-row-key"), headers.get("x-refers-to-key")
                    rows.append((int(key) if key and key.lstrip("-").isdigit() else None, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), raw, len(payload) if own else None, headers.get("warc-refers-to"), int(other) if other and other.lstrip("-").isdigit() else None, payload if own and with_payload else None))
                    held += len(payload) * with_payload
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``; a broken or falsified archive fails the read.

    Archives of other writers are read too: records of any type, digests that are absent (computed),
    in hexadecimal or by other algorithms.  ``payload`` is the block without the HTTP head; revisits
    have none.  An empty folder gives no rows.  Spark hands an archive to a task as one value: those of
    :func:`write` are bounded, those of other writers may have 2 GB at most and must fit in a worker.
    """
    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read_batches(with_payload), READ_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with revisits' ``payload_bytes`` taken from the responses they refer to."""
    named = records.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    meant = records.filter("record_type = 'response'").join(named.withColumnRenamed("refers_to_id", "record_id"), "record_id", "left_semi")
    meant = meant.groupBy("record_id").agg(F.max("payload_bytes").alias("meant_bytes")).withColumnRenamed("record_id", "refers_to_id")
    return records.join(meant, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "meant_bytes")).drop("meant_bytes")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(choose_revisits(table(spark, sf_dir, "pages")), path)
    records = materialise(read(spark, path, with_payload=False).drop("payload"), "warc-read")
    return resolve(records).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no archives; this is what reading them back must give.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     w AS (SELECT h, max(page_id) AS top, count(*) AS c FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN w.top IS NOT NULL AND d.page_id <> w.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.top IS NOT NULL AND d.page_id <> w.top THEN w.top END AS refers_to
FROM d LEFT JOIN w ON d.h = w.h AND d.n >= 1000
"""
