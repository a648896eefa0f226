"""Questions about elements, as relations over the numbered tree.

All take the rows of :func:`shelfmark.sources.pages.dom_nodes`.  An aggregate per page combines
before it shuffles, so that one small row per page moves, not its elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.text import collapse, strip, type_name

META_LABELS = ("property", "name", "itemprop")
VALUE_ATTRIBUTE = {"content": ("meta",), "src": ("audio", "embed", "iframe", "img", "source", "track", "video"), "href": ("a", "area", "link"), "data": ("object",), "value": ("data", "meter"), "datetime": ("time",)}


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def metas(dom: DataFrame, *keys: str) -> DataFrame:
    """The first non-blank ``<meta>`` of each key: one row per page, a column per key (``:`` as ``_``)."""
    tags = dom.filter("tag = 'meta'").withColumn("content", strip(attribute("content"))).filter("content <> ''")

    def first(key: str) -> Column:
        said = [F.lower(strip(attribute(label))).isin(key.lower(), f"og:{key.lower()}") for label in META_LABELS]
        hit = F.coalesce(said[0], F.lit(False)) | F.coalesce(said[1], F.lit(False)) | F.coalesce(said[2], F.lit(False))
        return F.min_by(F.when(hit, F.col("content")), F.when(hit, F.col("nid"))).alias("meta_" + key.replace(":", "_"))

    return tags.groupBy("page_id").agg(*[first(k) for k in keys])


def link(dom: DataFrame, rel: str) -> DataFrame:
    """``page_id``, ``href`` of the first ``<link>`` that has ``rel`` among its relations."""
    named = F.array_contains(F.split(F.lower(attribute("rel")), rf"[{P.WS}]+"), rel.lower())
    hits = dom.filter("tag = 'link'").filter(named & (attribute("href") != ""))
    return hits.groupBy("page_id").agg(F.min_by(strip(attribute("href")), "nid").alias("href"))


def title(dom: DataFrame) -> DataFrame:
    """``page_id``, ``title``: the text of the first ``<title>``, null if it is empty."""
    return dom.filter("tag = 'title'").groupBy("page_id").agg(F.nullif(F.min_by(strip(F.col("own_text")), "nid"), F.lit("")).alias("title"))


def canonical_url(dom: DataFrame) -> DataFrame:
    """``page_id``, ``url``: the canonical link, else the ``url`` meta."""
    both = link(dom, "canonical").join(metas(dom, "url"), "page_id", "full")
    return both.select("page_id", F.coalesce("href", "meta_url").alias("url"))


def ancestors(dom: DataFrame, limit: int = 40) -> DataFrame:
    """``page_id``, ``nid``, ``ancestor``, ``distance`` (1 for the parent), without a join."""
    return dom.select("page_id", "nid", F.posexplode(F.slice("anc", 1, limit)).alias("distance", "ancestor")).withColumn("distance", F.col("distance") + 1)


#: Elements are met through stretches of so many numbers, not page against page.
STRETCH = 128


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of elements of one page where ``outer`` holds ``inner``: ``outer.nid < nid <= outer.last``.

    An outer element is filed under every stretch of numbers that its interval touches and an inner
    one under its own, so that the join is by equality and compares only elements near each other.
    """
    o = outer.select("page_id", F.col("nid").alias("outer_nid"), F.col("last").alias("outer_last"), F.col("depth").alias("outer_depth"))
    o = o.filter("outer_last > outer_nid").withColumn("stretch", F.explode(F.sequence(F.floor((F.col("outer_nid") + 1) / STRETCH), F.floor(F.col("outer_last") / STRETCH))))
    i = inner.withColumn("stretch", F.floor(F.col("nid") / STRETCH))
    return i.join(o, ["page_id", "stretch"]).filter("outer_nid < nid and nid <= outer_last").drop("stretch")


def nearest_scope(dom: DataFrame, scope: str = "itemscope", prop: str = "itemprop") -> DataFrame:
    """Every element with ``prop`` and the innermost element with ``scope`` around it (null if none)."""
    scopes = dom.filter(F.map_contains_key("attrs", scope))
    props = dom.filter(F.map_contains_key("attrs", prop)).withColumn("prop", attribute(prop))
    held = within(props.select("page_id", "nid"), scopes).groupBy("page_id", "nid").agg(F.max_by("outer_nid", "outer_depth").alias("scope_nid"))
    return props.join(held, ["page_id", "nid"], "left")


def stated_value(base: Column) -> Column:
    """What an annotated element states: its tag's attribute, else ``content``, else its text; 500 characters."""
    own = F.coalesce(*[F.when(F.col("tag").isin(*tags), attribute(name)) for name, tags in VALUE_ATTRIBUTE.items()])
    return F.substring(F.coalesce(strip(F.coalesce(own, attribute("content"))), collapse(F.col("text"))), 1, 500)


def annotations(dom: DataFrame, scope: str = "itemscope", prop: str = "itemprop", kind: str = "itemtype") -> DataFrame:
    """Microdata as a relation: ``scope_nid``, ``scope_type``, ``name``, ``value``, ``inner_nid``.

    A property that is a scope itself has ``inner_nid`` in place of a value.
    """
    held = nearest_scope(dom, scope, prop).filter("scope_nid is not null")
    types = dom.filter(F.map_contains_key("attrs", scope)).select("page_id", F.col("nid").alias("scope_nid"), type_name(attribute(kind)).alias("scope_type"))
    named = held.join(types, ["page_id", "scope_nid"]).withColumn("name", F.explode(F.filter(F.split("prop", rf"[{P.WS}]+"), lambda s: s != "")))
    inner = F.map_contains_key("attrs", scope)
    return named.select(
        "page_id", "nid", "scope_nid", "scope_type", F.element_at(F.split("name", ":"), -1).alias("name"),
        F.when(~inner, stated_value(F.lit(None))).alias("value"), F.when(inner, F.col("nid")).alias("inner_nid"),
    )


def breadcrumbs(dom: DataFrame) -> DataFrame:
    """``page_id``, ``trail``: labels under the first landmark that calls itself a breadcrumb and has two."""
    said = F.lower(F.concat_ws(" ", *[attribute(k) for k in ("class", "id", "aria-label", "role", "data-testid")]))
    marks = dom.filter(F.col("tag").isin("nav", "ol", "ul", "div") & said.contains("breadcrumb"))
    parts = within(dom.filter(F.col("tag").isin("a", "li", "span")), marks)
    named = parts.select("page_id", "outer_nid", "nid", collapse(F.col("text")).alias("t")).filter((F.length("t") < 60) & ~F.lower("t").isin(*P.CRUMB_NOISE))
    first = named.groupBy("page_id", "outer_nid", F.lower("t").alias("low")).agg(F.min(F.struct("nid", "t")).alias("x"))
    trails = first.groupBy("page_id", "outer_nid").agg(F.sort_array(F.collect_list("x")).alias("xs")).filter(F.size("xs") >= 2)
    return trails.groupBy("page_id").agg(F.min_by(F.slice(F.transform("xs", lambda x: x["t"]), 1, 8), "outer_nid").alias("trail"))


def product_container(dom: DataFrame) -> DataFrame:
    """``page_id``, the first heading's ancestors, and the element eight levels up (or the topmost)."""
    h1 = dom.filter("tag = 'h1'").groupBy("page_id").agg(F.min_by(F.struct("nid", "anc"), "nid").alias("h"))
    chain = F.slice("h.anc", 1, 8)
    return h1.select("page_id", F.col("h.nid").alias("h1_nid"), F.col("h.anc").alias("h1_anc"), F.coalesce(F.try_element_at(chain, F.lit(-1)), F.col("h.nid")).alias("container"))


def visible_text(page: Column, most: int = 3500) -> Column:
    """The page's lines as a reader sees them, each once, 2 to 399 characters long."""
    from shelfmark.functions.text import unescape_common

    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript|svg|template)\b.*?</\1>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), "<[^>]+>", "\n")
    lines = F.transform(F.split(unescape_common(bare), "\n"), strip)
    kept = F.array_distinct(F.filter(lines, lambda s: (F.length(s) > 1) & (F.length(s) < 400)))
    return F.substring(F.array_join(kept, "\n"), 1, most)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group by an explicit order: keep-first de-duplication."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
