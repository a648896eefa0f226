"""From pages to records: the whole plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.text import collapse
from shelfmark.operators import dom as D
from shelfmark.operators import fields, graph, images, quality, taxonomy, variants
from shelfmark.sources.catalog import PRODUCT
from shelfmark.sources.pages import dom_nodes, json_nodes, json_strings, parsed_pages
from shelfmark.sources.stages import bucket_count, bucketed, kept, settled

ANSWERS = "page_id long, category_path string, key_features array<string>, colors array<string>, axis_names array<struct<original: string, normalized: string>>, product_image_indices array<int>"


def _trails(parsed: DataFrame, dom: DataFrame, nodes: DataFrame, site: DataFrame) -> DataFrame:
    """The merchant's category path: annotated, else from the landmark; the shop's own name goes."""
    both = parsed.select("page_id").join(graph.graph_breadcrumbs(nodes), "page_id", "left").join(D.breadcrumbs(dom).withColumnRenamed("trail", "dom_trail"), "page_id", "left").join(site, "page_id", "left")
    trail = F.coalesce("trail", "dom_trail", F.array().cast("array<string>"))

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    head = plain(F.try_element_at(trail, F.lit(1)))
    shop = F.coalesce((head != "") & (head == plain(F.col("meta_site_name"))), F.lit(False))
    return both.select("page_id", F.when(shop, F.slice(trail, 2, F.greatest(F.size(trail) - 1, F.lit(0)))).otherwise(trail).alias("trail"))


def flattened(parsed: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, objects and products as tables.

    Read some twenty times, a few columns each: as flat tables the scans are pruned, which those of nested arrays are not.
    """
    dom, nodes = kept(dom_nodes(parsed), "elements", buckets, "nid"), kept(graph.scored(json_nodes(parsed)), "objects", buckets, "n")
    return dom, nodes, kept(graph.product_nodes(nodes), "products", buckets)


def facts(parsed: DataFrame, buckets: int | None = None, flat: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per page with everything read from it: fields, images, video, variants, trail, signals.

    ``parsed`` is used many times and should be a written table, best in ``buckets`` of its pages: all
    is told of one page at a time, so that nothing then leaves its bucket.  ``flat`` has its elements,
    objects and products where they are written already.
    """
    dom, nodes, products = flat or flattened(parsed, buckets)
    strings, spark = json_strings(parsed), parsed.sparkSession
    scalar = settled(spark, lambda: fields.resolve(parsed, dom, nodes, products, buckets), "fields", buckets)
    ids = kept(images.identities(parsed, dom, nodes), "identities", buckets)
    signals = parsed.select("page_id", (F.coalesce(F.col("body_text").rlike(P.BUY_WORDS), F.lit(False)) | F.coalesce(F.substring("html", 1, 400_000).rlike(P.BUY_WORDS), F.lit(False))).alias("can_buy"), F.coalesce(F.col("html").rlike(P.LISTING_TYPE), F.lit(False)).alias("lists"))
    rows = signals
    for part in (
        scalar, settled(spark, lambda: images.resolve(dom, nodes, strings, ids, buckets), "images", buckets), images.resolve_video(dom, nodes, ids, buckets),
        settled(spark, lambda: variants.derive(parsed, nodes, ids, scalar.select("page_id", "name"), products, buckets), "page-variants", buckets),
        _trails(parsed, dom, nodes, scalar.select("page_id", "meta_site_name")), quality.product_counts(products), D.metas(dom, "type"), D.canonical_url(dom),
    ):
        rows = rows.join(part, "page_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"image_urls": F.coalesce("image_urls", none), "n_nodes": F.coalesce("n_nodes", F.lit(0)), "n_products": F.coalesce("n_products", F.lit(0))}).drop("meta_site_name")
    return rows.withColumn("sources", F.array("name_src", "brand_src", "description_src", "price_src"))


def judged(rows: DataFrame, mode: str = "full") -> DataFrame:
    """``rows`` of :func:`facts` with ``warnings``, ``confidence`` and ``refused``."""
    has_nodes = F.col("n_nodes") > 0
    told = rows.withColumn("warnings", quality.page_warnings(has_nodes, F.col("name_src"), F.col("price"), F.col("image_urls"), F.col("description"), F.col("n_products"), F.col("can_buy"), F.col("meta_type"), F.col("lists"), F.col("sources")))
    told = told.withColumn("confidence", quality.confidence(F.col("name"), F.col("price"), F.col("image_urls"), F.col("brand"), F.col("description"), F.col("trail"), has_nodes, F.col("sources"), F.col("warnings")))
    return told.withColumn("refused", quality.refusal(F.col("warnings"), F.col("price"), F.col("confidence"), mode))


def categorised(rows: DataFrame, tax: DataFrame, answers: DataFrame) -> DataFrame:
    """``rows`` with ``category``: a supplied answer made valid, else the nearest path by words."""
    asked = rows.select(F.col("page_id").alias("query_id"), taxonomy.retrieval_query(F.col("name"), F.col("brand"), F.col("trail"), F.col("description")).alias("query"))
    nearest = taxonomy.lexical_only(asked, tax).withColumnRenamed("query_id", "page_id").withColumnRenamed("category", "lexical")
    given = answers.filter("category_path is not null").select(F.col("page_id").alias("query_id"), F.col("category_path").alias("answer"))
    coerced = taxonomy.coerce(given, tax).select(F.col("query_id").alias("page_id"), F.col("category").alias("answered"))
    last = tax.agg(F.max_by("path", "ord").alias("last_path"))
    joined = rows.join(nearest, "page_id", "left").join(coerced, "page_id", "left").join(answers.drop("category_path"), "page_id", "left").crossJoin(F.broadcast(last))
    lexical = F.col("answered").isNull()
    return joined.withColumn("category", F.coalesce("answered", "lexical", "last_path")).withColumn("warnings", F.when(lexical & F.col("refused").isNull(), F.array_append("warnings", F.lit(quality.LEXICAL))).otherwise(F.col("warnings")))


def assembled(rows: DataFrame) -> DataFrame:
    """Results in their final shape; a refused page has no product, never one at price zero."""
    renames = quality.axis_renames(F.col("axis_names"), F.transform("options", lambda o: o["name"]))

    def named(word: Column) -> Column:
        return F.coalesce(F.try_element_at("renames", word), word)

    none = F.array().cast("array<string>")
    told = rows.withColumn("renames", renames)
    options = F.transform(F.filter("options", lambda o: F.size(o["values"]) > 0), lambda o: F.struct(named(o["name"]).alias("name"), o["values"].alias("values")))
    price = F.struct("price", F.coalesce("currency", F.lit("USD")).alias("currency"), "compare_at_price")

    def variant(v: Column) -> Column:
        own = F.when(v["price"]["price"].isNotNull(), F.struct(v["price"]["price"].alias("price"), F.coalesce(v["price"]["currency"], F.col("currency"), F.lit("USD")).alias("currency"), v["price"]["compare_at_price"].alias("compare_at_price")))
        keyed = F.map_from_entries(F.transform(F.map_entries(v["options"]), lambda e: F.struct(named(e["key"]).alias("key"), e["value"].alias("value"))))
        return F.struct(v["sku"].alias("sku"), keyed.alias("options"), own.alias("price"), v["image_urls"].alias("image_urls"), v["availability"].alias("availability"), v["gtin"].alias("gtin"), v["mpn"].alias("mpn"))

    given = F.filter(F.coalesce("key_features", none), lambda f: f != "")
    product = F.struct(
        F.coalesce("name", F.lit("")).alias("name"), price.alias("price"), F.coalesce("description", F.lit("")).alias("description"),
        F.slice(given, 1, 6).alias("key_features"), quality.image_judgement(F.col("image_urls"), F.col("product_image_indices")).alias("image_urls"), F.col("video_url"),
        F.struct(F.col("category").alias("name")).alias("category"), F.coalesce("brand", F.lit("")).alias("brand"),
        F.when(F.size("colors") > 0, F.col("colors")).otherwise(F.filter(F.coalesce("answer_colors", none), lambda c: c != "")).alias("colors"),
        F.transform("variants", variant).alias("variants"), options.alias("options"),
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"{k}_src").alias("value")) for k in ("name", "brand", "description", "price")])
    sources = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return told.select("page_id", F.when(F.col("refused").isNull(), product.cast(PRODUCT)).alias("product"), "url", "source", "confidence", "warnings", sources.alias("field_sources"), "refused")


def extract(pages: DataFrame, tax: DataFrame, answers: DataFrame | None = None, mode: str = "full", id_col: str = "page_id", html_col: str = "html", source_col: str | None = None) -> DataFrame:
    """Pages to results; see :func:`assembled`.  Pages are parsed once, into a table.

    ``answers`` (optional) are judgements made elsewhere, by page; without one the category is the
    nearest by words, and a warning says so.
    """
    spark = pages.sparkSession
    buckets = bucket_count(spark, pages.select(id_col).count())
    parsed = bucketed(parsed_pages(pages, id_col, html_col, buckets), "parsed", buckets, placed=True)
    answers = answers if answers is not None else spark.createDataFrame([], ANSWERS)
    rows = judged(bucketed(facts(parsed, buckets), "facts", buckets), mode)
    told = categorised(rows, tax, answers.withColumnRenamed("colors", "answer_colors"))
    if source_col:
        named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(source_col).alias("source"))
        told = told.join(named, "page_id", "left")
    else:
        told = told.withColumn("source", F.lit(None).cast("string"))
    return assembled(told)


def report(results: DataFrame) -> DataFrame:
    """``page_id``, ``line``: the console line of each page."""
    p = F.col("product")
    good = F.concat(
        F.rpad(F.coalesce("source", F.lit("")), 16, " "), F.lit(" "), F.format_string("%5.2f", "confidence"), F.lit(" "), p["price"]["currency"], F.lit(" "), F.format_string("%,7.2f", p["price"]["price"]),
        F.lit(" "), F.format_string("%5d %5d %5d", F.size(p["image_urls"]), F.size(p["variants"]), F.size(p["options"])), F.lit("  "), F.substring(p["category"]["name"], 1, 46),
    )
    bad = F.concat(F.rpad(F.coalesce("source", F.lit("")), 16, " "), F.lit(" "), F.format_string("%5.2f", "confidence"), F.lit("    REFUSED   "), F.substring(F.array_join("warnings", "; "), 1, 60))
    return results.select("page_id", F.when(p.isNotNull(), good).otherwise(bad).alias("line"))


def profile(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """What a page is made of: title, heading, links, elements, text lines, and why it gives no record."""
    parsed = parsed_pages(pages, id_col, html_col)
    dom = F.col("dom")

    def first(tag: str) -> Column:
        return F.try_element_at(F.filter(dom, lambda n: n["tag"] == tag), F.lit(1))["text"]

    shown = D.visible_text(F.col("html"), 1 << 30)
    return parsed.select(
        "page_id", first("title").alias("title"), first("h1").alias("h1"), F.size(dom).alias("n_elements"), F.array_max(F.transform(dom, lambda n: n["depth"])).alias("depth"),
        F.size(F.filter(dom, lambda n: n["tag"] == "a")).alias("n_links"), F.size("objects").alias("n_objects"), F.length(collapse(shown)).alias("n_visible"),
    )
