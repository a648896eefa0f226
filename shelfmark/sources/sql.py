"""Parsing as table functions, for SQL: ``SELECT ... FROM pages p, LATERAL parse_html(p.html)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from shelfmark.sources.pages import parse_page
from shelfmark.sources.stages import ship_package

ELEMENT = T.StructType([T.StructField(n, T.StringType() if n in ("tag", "own_text", "text") else T.IntegerType()) for n in ("nid", "parent", "last", "depth", "tag", "own_text", "text")])
MEMBER = T.StructType([T.StructField(n, T.StringType() if n in ("carrier", "path", "k", "kind", "value") else T.IntegerType()) for n in ("b", "carrier", "n", "last", "parent", "path", "ord", "k", "kind", "value", "child")])


class ParseHtml:
    """A row for each element of a page, in order; ``attributes`` (a constant) names some to have as columns."""

    @staticmethod
    def analyze(html: AnalyzeArgument, attributes: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(html.dataType, (T.StringType, T.NullType)):
            raise ValueError("parse_html reads a string")
        if attributes is not None and not attributes.isConstantExpression:
            raise ValueError("the attributes of parse_html are a constant")
        schema = T.StructType(list(ELEMENT.fields))
        for name in _names(attributes.value if attributes is not None else None):
            schema.add(name, T.StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str | None, attributes: str | None = None) -> Iterator[tuple]:
        wanted = _names(attributes)
        for n in parse_page(html)["dom"]:
            own = dict(n["attrs"])
            yield (n["nid"], n["parent"], n["last"], n["depth"], n["tag"], n["own_text"], n["text"], *map(own.get, wanted))


def _names(attributes: str | None) -> list[str]:
    return [a.strip().lower() for a in (attributes or "").split(",") if a.strip()]


class HarvestBlobs:
    """A row for each member of each JSON object of a page, in order; ``carrier`` (a constant, optional) keeps one kind only."""

    @staticmethod
    def analyze(html: AnalyzeArgument, carrier: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(html.dataType, (T.StringType, T.NullType)):
            raise ValueError("harvest_blobs reads a string")
        return AnalyzeResult(MEMBER)

    def eval(self, html: str | None, carrier: str | None = None) -> Iterator[tuple]:
        for o in parse_page(html)["objects"]:
            if carrier is None or o["carrier"] == carrier:
                for i, m in enumerate(o["kv"]):
                    yield o["b"], o["carrier"], o["n"], o["last"], o["parent"], o["path"], i, m["k"], m["kind"], m.get("s"), m.get("child")


def register(spark: SparkSession) -> None:
    """Make ``parse_html`` and ``harvest_blobs`` known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("parse_html", udtf(ParseHtml))
    spark.udtf.register("harvest_blobs", udtf(HarvestBlobs))
