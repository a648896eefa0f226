"""Product pages written from ``part`` and ``lineitem``, so that extraction runs on as many as there are parts.

A part is a product; its line items by return flag and line number are its variants, 21 at most.
Every part has a page of one of twelve shapes, by its key: one for each carrier of structured data,
and for what is read from elements alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.graph import product_nodes, score, scored
from shelfmark.sources.pages import KINDS, dom_nodes, json_nodes, of_kind, page_rows, parsed_pages
from shelfmark.sources.stages import bucket_count, bucketed, ship_package

#: Column names between these marks stand for their values.
_HOLE = re.compile("«(\\w+)»")
COLOURS = {"A": "Amber", "N": "Navy", "R": "Red"}

_HEAD = '<html><head><title>«name» | Shelf Shop</title><link rel="canonical" href="https://shop.example.com/p/part-«id»">'
_BODY = "</head><body><main><h1>«name»</h1>"
_END = "<button>Add to cart</button></main></body></html>"
_SITE = '<meta property="og:site_name" content="Shelf Shop">'
_FACTS = '"name":"«name»","sku":"P«id»","description":"«text»"'

SHAPES = (
    # 0: JSON-LD with an offer, its shipping charge and a trail; the price before stands in the page alone.
    _HEAD + _SITE + _BODY + '<script type="application/ld+json">{"@type":"Product",' + _FACTS + ',"brand":{"@type":"Brand","name":"«brand»"},"image":["«img»-a_1200x1200.jpg","«img»-b_1200x1200.jpg"],'
    '"offers":{"@type":"Offer","price":"«price»","priceCurrency":"EUR","availability":"https://schema.org/InStock","shippingDetails":{"@type":"OfferShippingDetails","shippingRate":{"value":"4.90","currency":"EUR"}}}}</script>'
    '<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","name":"Shelf Shop"},{"@type":"ListItem","item":{"name":"«type»"}},{"@type":"ListItem","name":"«name»"}]}</script>'
    '<p class="price">«price» &euro; <del class="was-price">«was» &euro;</del></p>' + _END,
    # 1: a state object in JavaScript, rows by position, a method and an expression in it.
    _HEAD + _BODY + "<script>window.__STATE__ = {handlers:{onBuy(){return {a:1}}},product:{name:'«name»',brand:\"«brand»\",sku:'P«id»',price:«price»,currency:'GBP',description:\"«text»\","
    'images:["«img»-a.jpg","«img»-b.jpg"],options:["Color","Size"],variants:[«positional»]},later:compute(1,"}")};</script>' + _END,
    # 2: the same returned by a function, whose arguments are not known.
    _HEAD + _SITE + _BODY + '<script>window.__NUXT__=(function(a,b){return {product:{name:"«name»",brand:a,price:«price»,currency:"EUR",sku:"P«id»",description:"«text»",image:"«img».jpg"},later:b}}("x",1));</script>' + _END,
    # 3: JSON.parse, rows by axis, stock by warehouse.
    _HEAD + _BODY + '<script>var data = JSON.parse(\'{"product":{' + _FACTS + ',"brand":"«brand»","price":"«price»","currency":"USD","image":"«img».jpg","variants":[«keyed»]}}\');</script>' + _END,
    # 4: an attribute, rows with pairs, pictures and quantities; another attribute with escaped quotes.
    _HEAD + _BODY + "<div data-product='{" + _FACTS + ',"brand":"«brand»","price":«price»,"currency":"GBP","image":"«img».jpg","variants":[«paired»]}\'></div><div data-more="{&quot;note&quot;:&quot;entity escaped&quot;}"></div>' + _END,
    # 5: a string literal with a prefix, rows with maps.
    _HEAD + _BODY + '<script>self.__f=self.__f||[];self.__f.push([1,"4:«flight»"])</script>' + _END,
    # 6: Microdata.
    _HEAD + '</head><body><main><div itemscope itemtype="http://schema.org/Product"><h1 itemprop="name">«name»</h1><meta itemprop="sku" content="P«id»"><span itemprop="brand" itemscope itemtype="http://schema.org/Brand"><span itemprop="name">«brand»</span></span>'
    '<p itemprop="description">«text»</p><img itemprop="image" src="«img».jpg"><div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="priceCurrency" content="GBP"><span itemprop="price" content="«price»">now</span></div></div>' + _END,
    # 7: RDFa.
    _HEAD + '</head><body><main><div vocab="http://schema.org/" typeof="Product"><h1 property="name">«name»</h1><meta property="sku" content="P«id»"><span property="brand">«brand»</span><p property="description">«text»</p><img property="image" src="«img».jpg">'
    '<div property="offers" typeof="Offer"><meta property="priceCurrency" content="EUR"><span property="price" content="«price»">now</span></div></div>' + _END,
    # 8: a store of rows that name each other.
    _HEAD + _BODY + '<script type="application/json">{"Product:«id»":{"id":"Product:«id»",' + _FACTS + ',"brand":{"__ref":"Brand:«id»"},"price":"«price»","currency":"USD","mediaId":"Media:«id»"},"Brand:«id»":{"id":"Brand:«id»","name":"«brand»"},'
    '"Media:«id»":{"id":"Media:«id»","url":"«img».jpg"}}</script>' + _END,
    # 9: axes as questions, each answer with the articles it leaves; one article has no size.
    _HEAD + _BODY + '<script type="application/json">{"item":{' + _FACTS + ',"price":"«price»","currency":"USD","image":"«img».jpg"},"questions":[{"label":"Color","answers":[«by_color»,{"label":"Grey","skus":["X«id»"]}]},{"label":"Size","answers":[«by_size»]}]}</script>' + _END,
    # 10: price, trail, pictures and video in elements; a charge and another product's price beside them.
    _HEAD + '<link rel="preload" as="image" href="«img»-2_600x600.jpg"><meta property="og:image" content="«img»-1_1200x1200.jpg"></head><body><nav aria-label="breadcrumb"><a href="/">Home</a><a href="/t">«type»</a><a href="/n">«name»</a></nav>'
    '<main><script type="application/ld+json">{"@type":"Product",' + _FACTS + ',"brand":"«brand»"}</script><h1>«name»</h1><div class="gallery"><img data-src="«img»-1_600x600.jpg" src="data:image/gif;base64,R0lGOD">'
    '<img srcset="«img»-2_300x300.jpg 300w, «img»-2_1200x1200.jpg 1200w"></div><video src="https://cdn.example.com/v/part-«id».mp4"></video><div class="related-products"><img src="https://cdn.example.com/img/other.jpg"><span class="price">$9</span></div>'
    '<p class="shipping-note">Delivery from $3</p><p class="price">$«price»</p>' + _END,
    # 11: a range of offers, some of them sold out.
    _HEAD + _BODY + '<script type="application/ld+json">{"@type":"Product",' + _FACTS + ',"brand":"«brand»","image":"«img».jpg","offers":{"@type":"AggregateOffer","lowPrice":"«low»","highPrice":"«high»","priceCurrency":"USD","offers":[«offers»]}}</script>' + _END,
)

FLIGHT = '["$","div",null,{"product":{' + _FACTS + ',"brand":{"name":"«brand»"},"offers":{"price":"«price»","priceCurrency":"USD"},"image":["«img».jpg"],"variants":[«mapped»]}}]'


def _filled(template: str) -> Column:
    parts = _HOLE.split(template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def _listed(template: str) -> Column:
    """One filled template for each variant, in order; holes name fields of the variant or ``id`` and ``img`` of its part."""
    parts = _HOLE.split(template)

    def one(v: Column) -> Column:
        return F.concat(*[(F.col(p) if p in ("id", "img") else v[p]).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])

    return F.array_join(F.transform("variants", one), ",")


def _answers(field: str, prefix: str) -> Column:
    """``{"label": .., "skus": [..]}`` for each value of a field, in order."""

    def one(value: Column) -> Column:
        skus = F.transform(F.filter("variants", lambda v: v[field] == value), lambda v: F.concat(F.lit('"'), v["sku"], F.lit('"')))
        return F.concat(F.lit(f'{{"label":"{prefix}'), value.cast("string"), F.lit('","skus":['), F.array_join(skus, ","), F.lit("]}"))

    return F.array_join(F.transform(F.sort_array(F.array_distinct(F.transform("variants", lambda v: v[field]))), one), ",")


def _money(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def shop_buckets(spark: SparkSession, sf_dir: str) -> int:
    return bucket_count(spark, spark.read.parquet(f"{sf_dir}/part.parquet").count())


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id``, ``source``, ``html``: a page for each part.  Line items are shuffled once, by part."""
    buckets = shop_buckets(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_returnflag", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")).repartition(buckets, "l_partkey")
    rows = items.groupBy("l_partkey", "l_returnflag", "l_linenumber").agg(F.min("cents").alias("cents"), F.count("*").alias("n"))
    colour = F.element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), F.col("l_returnflag"))
    variant = F.struct(
        colour.alias("color"), F.col("l_linenumber").alias("line"), F.concat(F.lit("S"), "l_partkey", F.lit("-"), "l_returnflag", "l_linenumber").alias("sku"), "cents", _money(F.col("cents")).alias("price"),
        (F.col("n") % 2).alias("stock"), (F.col("n") % 2 == 1).alias("sold"), F.lower(colour).alias("shade"), F.when(F.col("n") % 2 == 1, "InStock").otherwise("OutOfStock").alias("state"),
    )
    # By flag and line number a part has 21 variants at most, however many line items.
    variants = rows.groupBy("l_partkey").agg(F.sort_array(F.collect_list(variant)).alias("variants"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(buckets, "p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    known = part.join(variants, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), _money(cents).alias("price"), _money(cents + 2000).alias("was"),
        F.format_string("A %s of type %s, number %s, kept on the shelf.", "p_name", "p_type", "p_size").alias("text"), F.concat(F.lit("https://cdn.example.com/img/part-"), "p_partkey").alias("img"), "variants",
    )
    lists = {
        "positional": _listed('{sku:"«sku»",option1:"«color»",option2:"L«line»",available:«sold»,price:«price»}'),
        "keyed": _listed('{"sku":"«sku»","color":"«color»","size":"L«line»","price":"«price»","warehouses":[{"stock":0},{"stock":«stock»}]}'),
        "paired": _listed('{"sku":"«sku»","selectedOptions":[{"name":"Size","value":"L«line»"},{"name":"Color","value":"«color»"}],"price":"«price»","currency":"GBP","quantity":«stock»,"image":{"url":"«img»-«shade».jpg"}}'),
        "mapped": _listed('{"sku":"«sku»","attributes":{"Color":"«color»","Size":"L«line»"},"price":"«price»","available":«sold»}'),
        "offers": _listed('{"@type":"Offer","price":"«price»","availability":"https://schema.org/«state»"}'),
        "by_color": _answers("color", ""), "by_size": _answers("line", "L"),
        "low": _money(F.array_min(F.transform("variants", lambda v: v["cents"]))), "high": _money(F.array_max(F.transform("variants", lambda v: v["cents"]))),
    }
    full = known.withColumns(lists).withColumn("flight", F.replace(_filled(FLIGHT), F.lit('"'), F.lit('\\"')))
    page = F.lit(None).cast("string")
    for shape, template in enumerate(SHAPES):
        page = F.when(F.col("id") % len(SHAPES) == shape, _filled(template)).otherwise(page)
    return full.select(F.col("id").cast("long").alias("page_id"), F.concat(F.lit("part-"), "id", F.lit(".html")).alias("source"), page.alias("html"))


def shop_taxonomy(spark: SparkSession) -> DataFrame:
    """``path``, ``ord``: a category for each kind of part."""
    kinds = ("bolt", "nut", "gear", "ring", "washer", "screw", "pin", "spring", "valve", "plate")
    return spark.createDataFrame([(f"Hardware > Parts > {k.title()}s", i) for i, k in enumerate(kinds)], "path string, ord int")


class ShopRun:
    """The pages of a folder through the plan, each step at its first use, as tables in buckets of their pages.

    ``pages``, of these ``elements``, ``objects``, ``products`` and ``parsed`` (texts and list strings), then ``facts`` and
    ``results``.  Elements and objects are read from the pages each by itself, straight into the rows of their table: a
    query waits for no more than it asks for, and no page is kept whole with all its rows beside the tables of these.
    What needs all of them has those that are not there yet from one pass: a page's tree and blobs are then read once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}
        self.buckets = shop_buckets(spark, sf_dir)

    def __getitem__(self, step: str) -> DataFrame:
        if step not in self.made:
            self.made[step] = getattr(self, f"_{step}")()
        return self.made[step]

    def kept(self, df: DataFrame, label: str, *within: str) -> DataFrame:
        """What a query makes of these tables, computed in their buckets."""
        return bucketed(df, label, self.buckets, within=within)

    def _pages(self) -> DataFrame:
        return self.kept(shop_pages(self.spark, self.sf_dir), "shop-pages")

    def _read(self, *parts: str) -> DataFrame:
        return parsed_pages(self["pages"], parts=parts)

    def _parsed(self) -> DataFrame:
        return bucketed(self._read("html", "body_text", "strings"), "parsed", self.buckets, placed=True)

    def _elements(self) -> DataFrame:
        return bucketed(dom_nodes(self._read("dom")), "elements", self.buckets, placed=True, within=("nid",))

    def _objects(self) -> DataFrame:
        return bucketed(scored(json_nodes(self._read("objects"))), "objects", self.buckets, placed=True, within=("n",))

    def _products(self) -> DataFrame:
        return self.kept(product_nodes(self["objects"]), "products")

    def read_at_once(self) -> None:
        """Elements, objects and texts, as far as they are not made yet, from one pass over the pages."""
        kinds = tuple(k for k in KINDS if k not in self.made)
        if len(kinds) > 1:
            rows = page_rows(self["pages"], kinds).withColumn("score", F.when(F.col("kind") == "objects", score()))
            table = bucketed(rows, "page-rows", self.buckets, placed=True, within=("num",), divided="kind")
            self.made |= {k: of_kind(table, k, *(("score",) if k == "objects" else ())) for k in kinds}

    def _facts(self) -> DataFrame:
        from shelfmark.plans.extract import facts

        self.read_at_once()
        return self.kept(facts(self["parsed"], self.buckets, (self["elements"], self["objects"], self["products"])), "facts")

    def _results(self) -> DataFrame:
        from shelfmark.plans.extract import ANSWERS, assembled, categorised, judged

        told = categorised(judged(self["facts"]), shop_taxonomy(self.spark), self.spark.createDataFrame([], ANSWERS).withColumnRenamed("colors", "answer_colors"))
        return self.kept(assembled(told.join(self["pages"].select("page_id", "source"), "page_id", "left")), "shop-results")


_RUNS: dict[tuple[str, str], ShopRun] = {}


def shop_run(spark: SparkSession, sf_dir: str) -> ShopRun:
    """The run of a folder, one for each application: a query that reads pages or elements alone pays for no more."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        ship_package(spark)
        _RUNS[key] = ShopRun(spark, sf_dir)
    return _RUNS[key]
