"""Pages in: files or tables, strict decoding, and the one Python step that parses them."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.sources import harvest
from shelfmark.sources.stages import ship_package
from shelfmark.sources.tree import Node, collapsed_text, deep_text, parse

SNIFFED = 4096
META_CHARSET = r"(?i)<meta[^>]+?charset\s*=\s*[\"']?\s*([a-zA-Z0-9_\-:.]+)"
HEADER_CHARSET = r"(?i)charset\s*=\s*([\w\-:.]+)"
MOST_BODY = 200_000
#: Elements keep so much of the text below them (the limit of Microdata values), but these keep all: repeated at
#: every level, whole texts would make a page as many times as large as it is deep.
MOST_TEXT = harvest.MOST_TEXT
WHOLE_TEXT = frozenset(("title", "h1", "h2", "h3", "h4", "h5", "h6", "a"))


def read_files(spark: SparkSession, *paths: str, pattern: str = "*.html") -> DataFrame:
    """``source``, ``content_type``, ``raw`` of page files, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.lit(None).cast("string").alias("content_type"), F.col("content").alias("raw"))


def declared_charsets(raw: Column, content_type: Column) -> Column:
    """Charsets to try in order: of the transport, of the document's start, UTF-8; each spelling once."""
    head = F.decode(F.substring(raw, 1, SNIFFED), "ISO-8859-1")
    named = F.array(F.regexp_extract(content_type, HEADER_CHARSET, 1), F.regexp_extract(head, META_CHARSET, 1), F.lit("utf-8"))
    named = F.filter(named, lambda c: c.isNotNull() & (c != ""))

    def same(c: Column) -> Column:
        return F.replace(F.lower(c), F.lit("_"), F.lit("-"))

    return F.filter(named, lambda c, i: F.array_position(F.transform(named, same), same(c)) == i + 1)


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, errors = [], []
        for raw, charsets in zip(batch.column("raw").to_pylist(), batch.column("charsets").to_pylist(), strict=True):
            text, tried = None, []
            for charset in charsets or [] if raw is not None else []:
                try:
                    text = raw.removeprefix(b"\xef\xbb\xbf").decode(charset)
                    break
                except (UnicodeDecodeError, LookupError) as error:
                    tried.append(f"{charset}: {type(error).__name__}")
            texts.append(text)
            errors.append(None if text is not None else "could not decode document; tried " + ", ".join(tried))
        rest = [batch.column(c) for c in batch.schema.names if c not in ("raw", "charsets")]
        names = [c for c in batch.schema.names if c not in ("raw", "charsets")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*names, "html", "error"])


def decode(pages: DataFrame) -> DataFrame:
    """``pages`` with ``html`` and ``error`` in place of ``raw``; wrong bytes are refused, never replaced."""
    ship_package(pages.sparkSession)
    named = pages.withColumn("charsets", declared_charsets(F.col("raw"), F.col("content_type")))
    kept = [f for f in pages.schema.fields if f.name != "raw"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "html string", "error string"])
    return named.select(*[f.name for f in kept], "raw", "charsets").mapInArrow(_decode_batches, schema)


DOM = "array<struct<nid: int, parent: int, last: int, depth: int, tag: string, attrs: map<string, string>, own_text: string, text: string, anc: array<int>, ctx6: string, ctx8: string>>"
VALUE = "kind: string, s: string, num: double, decoded: string, label: string, child: int"
OBJECTS = (
    f"array<struct<b: int, carrier: string, n: int, last: int, path: string, depth: int, parent: int, parent_key: string, pruned: string, "
    f"kv: array<struct<k: string, {VALUE}, items: array<struct<{VALUE}>>>>>>"
)
STRINGS = "array<struct<b: int, path: string, s: string, ord: int, pos: int>>"
#: What a page is read for; of what is not asked for there are nulls.
PARTS = ("html", "body_text", "dom", "objects", "strings")
PARSED = f"page_id long, html string, body_text string, dom {DOM}, objects {OBJECTS}, strings {STRINGS}"


def _dom_rows(nodes: list[Node]) -> list[dict]:
    words = [n.words() for n in nodes]
    out = []
    for n in nodes[1:]:
        up = n.ancestors()
        own = "".join(n.texts)
        shown = bool(own.strip()) or n.tag in ("img", "source", "video")
        out.append(
            {
                "nid": n.nid, "parent": n.parent.nid, "last": n.last, "depth": n.depth, "tag": n.tag, "attrs": list(n.attrs.items()), "own_text": own,
                "text": collapsed_text(n, None if n.tag in WHOLE_TEXT else MOST_TEXT), "anc": [a.nid for a in up if a.nid],
                "ctx6": " ".join(filter(None, [words[n.nid], *(words[a.nid] for a in up[:6])])).lower() if shown else None,
                "ctx8": " ".join(filter(None, [words[n.nid], *(words[a.nid] for a in up[:8])])).lower() if shown else None,
            }
        )
    return out


def canonical(nodes: list[Node]) -> str | None:
    """The page's own address: its canonical link, else the first of its ``url`` metas."""
    for n in nodes:
        if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href"):
            return n.attrs["href"].strip()
    for n in nodes:
        named = any(n.attrs.get(k, "").strip().lower() in ("url", "og:url") for k in ("property", "name", "itemprop"))
        if n.tag == "meta" and named and n.attrs.get("content", "").strip():
            return n.attrs["content"].strip()
    return None


def parse_page(page: str | None, parts: tuple[str, ...] = PARTS) -> dict:
    """The parts of a page; its objects are read only for themselves and the strings of their lists."""
    nodes = parse(page or "")
    out: dict = {"html": page if "html" in parts else None, "body_text": None, "dom": _dom_rows(nodes) if "dom" in parts else None, "objects": None, "strings": None}
    if "body_text" in parts and (body := next((n for n in nodes if n.tag == "body"), None)):
        out["body_text"] = deep_text(body, MOST_BODY, " ")[:MOST_BODY]
    if "objects" in parts or "strings" in parts:
        found = harvest.blobs(page or "", nodes, canonical(nodes))
        graph = harvest.followed(found)
        if "objects" in parts:
            out["objects"], strings = harvest.rows([c for c, _ in found], graph)
        else:
            strings = harvest.list_strings(graph)
        out["strings"] = strings if "strings" in parts else None
    return out


def _parse_batches(schema: pa.Schema, parts: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a page are thousands of small values without circles, which a search for circles would meet again and again.
        gc.set_threshold(200_000)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                parsed = [parse_page(p.as_py(), parts) for p in some.column(1)]
                made = [pa.array([p[c] for p in parsed], schema.field(c).type) for c in PARTS]
                yield pa.RecordBatch.from_arrays([some.column(0), *made], schema=schema)

    return run


def parsed_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", buckets: int | None = None, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per page with its elements, its JSON objects and list strings as ordered arrays.

    A reader of some ``parts`` alone names them: what it does not name is not read and comes as null.

    Persist or write the result before using it more than once: Spark would parse anew for each use.
    Bytes of a page that are no UTF-8 are read as U+FFFD; null and empty pages have no rows in their arrays.
    ``buckets`` deals the pages by the hash of their number first: a small file is one task otherwise.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.make_valid_utf8(F.col(html_col).cast("string")).alias("html"))
    rows = rows if buckets is None else rows.repartition(buckets, "page_id")
    kind = T.StructType.fromDDL(PARSED)
    return rows.mapInArrow(_parse_batches(to_arrow_schema(kind), parts), kind)


#: The rows of :func:`page_rows`: whose they are, which of :data:`KINDS` they are, their number in the page, and the columns of all kinds.
KINDS = {"elements": ("dom",), "objects": ("objects",), "parsed": ("html", "body_text", "strings")}


def _row_batches(schema: pa.Schema, kinds: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts = tuple(p for k in kinds for p in KINDS[k])

    def filled(ids: list[int], kind: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        known = {"page_id": pa.array(ids, pa.int64()), "kind": pa.array([kind] * len(ids), pa.string()), **columns}
        return pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(len(ids), f.type) for f in schema], schema=schema)

    def flat(pages: list[int], lists: list[list[dict]], kind: str, number: str) -> pa.RecordBatch:
        rows = [r for some in lists for r in some]
        ids = [page for page, some in zip(pages, lists, strict=True) for _ in some]
        names = {("num" if n == number else n): n for n in (rows[0] if rows else ())}  # all rows of a kind have the same
        return filled(ids, kind, {c: pa.array([r[n] for r in rows], schema.field(c).type) for c, n in names.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000)  # as in _parse_batches
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                pages = some.column(0).to_pylist()
                parsed = [parse_page(p.as_py(), parts) for p in some.column(1)]
                if "elements" in kinds:
                    yield flat(pages, [p["dom"] for p in parsed], "elements", "nid")
                if "objects" in kinds:
                    yield flat(pages, [p["objects"] for p in parsed], "objects", "n")
                if "parsed" in kinds:
                    yield filled(pages, "parsed", {c: pa.array([p[c] for p in parsed], schema.field(c).type) for c in KINDS["parsed"]})

    return run


def page_rows(pages: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of several kinds from one pass over the pages: elements, objects, and a row of texts and list strings for each page.

    A column that a kind does not have is null there; :func:`of_kind` gives the rows of one kind as they are by themselves.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.make_valid_utf8(F.col("html").cast("string")).alias("html"))
    columns = {"page_id": T.LongType(), "kind": T.StringType(), "num": T.IntegerType()}
    for field in (*_inner(DOM, "nid"), *_inner(OBJECTS, "n"), *T.StructType.fromDDL(PARSED)):
        if field.name not in ("dom", "objects"):
            columns.setdefault(field.name, field.dataType)
    kind = T.StructType([T.StructField(n, t) for n, t in columns.items()])
    return rows.mapInArrow(_row_batches(to_arrow_schema(kind), kinds), kind)


def _inner(kind: str, number: str) -> list[T.StructField]:
    return [f for f in T.StructType.fromDDL(f"x {kind}")["x"].dataType.elementType if f.name != number]


def of_kind(rows: DataFrame, kind: str, *more: str) -> DataFrame:
    """The rows of one kind out of :func:`page_rows`, with the columns that :func:`dom_nodes` and the others give, and ``more``."""
    own = rows.filter(F.col("kind") == kind)
    if kind == "parsed":
        return own.select("page_id", *KINDS[kind], *more)
    number, inner = ("nid", DOM) if kind == "elements" else ("n", OBJECTS)
    names = [f.name for f in T.StructType.fromDDL(f"x {inner}")["x"].dataType.elementType]
    return own.select("page_id", *[F.col("num").alias(n) if n == number else F.col(n) for n in names], *more)


def dom_nodes(parsed: DataFrame) -> DataFrame:
    """Elements in document order; an element ``a`` holds ``n`` if ``a.nid < n.nid <= a.last``."""
    return parsed.select("page_id", F.inline("dom"))


def json_nodes(parsed: DataFrame) -> DataFrame:
    """JSON objects in document order with their members; ``n`` and ``last`` nest like elements do."""
    return parsed.select("page_id", F.inline("objects"))


def json_strings(parsed: DataFrame) -> DataFrame:
    """Strings that are elements of JSON lists."""
    return parsed.select("page_id", F.inline("strings"))
