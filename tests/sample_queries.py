"""Sample pages with the rows that each part of the plan must give for them, written by hand.

The SQL lists the expected rows, it computes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import dom as D
from shelfmark.operators import graph
from shelfmark.plans.extract import extract, report
from shelfmark.plans.samples import framework_pages, sample_pages, sample_taxonomy
from shelfmark.sources.catalog import entries
from shelfmark.sources.pages import dom_nodes, json_nodes, json_strings, parsed_pages
from shelfmark.sources.stages import staged

QUERIES, SQL = {}, {}


def query(sql):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_SAMPLES: dict[str, DataFrame] = {}


def sample_results(spark: SparkSession) -> DataFrame:
    """The sample pages through the whole plan, once per application."""
    return _results(spark)[0]


def framework_results(spark: SparkSession) -> DataFrame:
    """The pages of application frameworks through the same run of the plan."""
    return _results(spark)[1]


def _results(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    key = spark.sparkContext.applicationId
    if key not in _SAMPLES:
        _SAMPLES[key] = staged(extract(sample_pages(spark).unionByName(framework_pages(spark)), sample_taxonomy(spark), source_col="source"), "samples")
    return _SAMPLES[key].filter("page_id < 21"), _SAMPLES[key].filter("page_id >= 21")


@query(
    """SELECT * FROM (VALUES (1, 'Pine Stool', 'Grainhouse', 89.0, 'EUR', 109.0, 'Furniture > Chairs > Stools', NULL), (2, 'Trail Lamp', 'Northlight', 39.0, 'USD', 45.0, 'Outdoor > Lighting > Head Lamps', NULL),
    (3, 'Wool Cap', 'Hatters', 24.5, 'GBP', NULL, 'Apparel > Hats > Caps', NULL), (4, 'Clay Jug', 'Kiln Row', 36.0, 'GBP', NULL, 'Kitchen > Serving > Jugs', NULL), (5, 'Rain Coat', '', 120.0, 'USD', NULL, 'Apparel > Coats > Rain Coats', NULL),
    (6, NULL, NULL, NULL, NULL, NULL, NULL, 'price'), (7, NULL, NULL, NULL, NULL, NULL, NULL, 'categorical'), (8, 'Field Bag', 'Canvas Co', 140.0, 'USD', NULL, 'Apparel > Bags > Field Bags', NULL)) AS t(page_id, name, brand, price, currency, compare_at, category, refused)"""
)
def pdp_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("product")
    return sample_results(spark).select("page_id", p["name"].alias("name"), p["brand"].alias("brand"), p["price"]["price"].alias("price"), p["price"]["currency"].alias("currency"), p["price"]["compare_at_price"].alias("compare_at"), p["category"]["name"].alias("category"), "refused")


@query(
    """SELECT * FROM (VALUES (1, '4471', '', NULL, 'unknown'), (2, NULL, '', NULL, 'unknown'), (3, 'C-GR-M', 'Color=Grey,Size=M', 24.5, 'out_of_stock'), (3, 'C-GR-S', 'Color=Grey,Size=S', 24.5, 'in_stock'), (3, 'C-NA-S', 'Color=Navy,Size=S', 26.0, 'in_stock'),
    (4, NULL, '', NULL, 'unknown'), (5, 'RC-1', 'Color=Black,Length=Short', NULL, 'unknown'), (5, 'RC-2', 'Color=Black,Length=Long', NULL, 'unknown'), (5, 'RC-3', 'Color=Olive,Length=Short', NULL, 'unknown'), (8, 'FB8', '', NULL, 'unknown')) AS t(page_id, sku, options, price, availability)"""
)
def pdp_extract_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_results(spark).filter("product is not null").select("page_id", F.explode("product.variants").alias("v"))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("v.options"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.select("page_id", "v.sku", told.alias("options"), F.col("v.price.price").alias("price"), "v.availability")


@query(
    """SELECT * FROM (VALUES (1, 'https://cdn.example.com/img/4471-a_1200x1200.jpg https://cdn.example.com/img/4471-b_1200x1200.jpg'), (2, 'https://cdn.example.com/img/lamp-77.jpg'), (3, 'https://cdn.example.com/img/cap-1.jpg https://cdn.example.com/img/cap-2.jpg'),
    (4, 'https://cdn.example.com/img/jug-1.jpg'), (5, 'https://cdn.example.com/img/coat.jpg'), (8, 'https://cdn.example.com/img/bag-2_1200x1200.jpg https://cdn.example.com/img/bag-1_1200x1200.jpg')) AS t(page_id, images)"""
)
def pdp_extract_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_results(spark).filter("product is not null").select("page_id", F.array_join("product.image_urls", " ").alias("images"))


@query("SELECT * FROM (VALUES (1, 'ld+json', 5), (2, 'ld+json', 5), (3, 'state:window.__DATA__', 5), (4, 'microdata', 3), (5, 'script-json', 8), (6, 'ld+json', 1), (8, 'ld+json', 1)) AS t(page_id, carrier, n)")
def pdp_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_nodes(parsed_pages(sample_pages(spark))).groupBy("page_id", "carrier").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (4, 'Product', 'name', 'Clay Jug'), (4, 'Product', 'brand', NULL), (4, 'Brand', 'name', 'Kiln Row'), (4, 'Product', 'description', 'Thrown by hand, glazed inside only.'), (4, 'Product', 'image', 'https://cdn.example.com/img/jug-1.jpg'), (4, 'Product', 'offers', NULL), (4, 'Offer', 'priceCurrency', 'GBP'), (4, 'Offer', 'price', '36.00')) AS t(page_id, scope_type, name, value)")
def pdp_microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microdata as a range join over numbered elements; the page boundary's own walk must agree (tests)."""
    return D.annotations(dom_nodes(parsed_pages(sample_pages(spark)))).select("page_id", "scope_type", "name", "value")


@query("SELECT * FROM (VALUES (1, 'Furniture > Stools')) AS t(page_id, trail)")
def pdp_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.breadcrumbs(dom_nodes(parsed_pages(sample_pages(spark)))).select("page_id", F.array_join("trail", " > ").alias("trail"))


@query("SELECT * FROM (VALUES (1, 89.0, 'EUR', 109.0), (4, 36.0, 'GBP', NULL), (8, 140.0, 'USD', NULL)) AS t(page_id, price, currency, compare_at)")
def pdp_dom_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money near the heading, without delivery charges."""
    from shelfmark.operators.fields import dom_price

    found = dom_price(dom_nodes(parsed_pages(sample_pages(spark))))
    return found.select("page_id", F.col("dom_price").alias("price"), F.col("dom_currency").alias("currency"), F.col("dom_compare").alias("compare_at"))


@query("SELECT * FROM (VALUES ('grainhouse-pine-stool'), ('northlight-trail-lamp'), ('hatters-wool-cap'), ('kiln-row-clay-jug'), ('rain-coat'), ('canvas-co-field-bag')) AS t(id)")
def pdp_catalog_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(sample_results(spark)).select("id")


@query("SELECT * FROM (VALUES (8, 'https://cdn.example.com/v/bag.mp4')) AS t(page_id, video)")
def pdp_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.operators import images

    parsed = parsed_pages(sample_pages(spark))
    dom, nodes = dom_nodes(parsed), json_nodes(parsed)
    return images.resolve_video(dom, nodes, images.identities(parsed, dom, nodes)).select("page_id", F.col("video_url").alias("video"))


@query("""SELECT * FROM (VALUES (1, 'https://shop.example.com/p/pine-stool-4471', 'Grainhouse', 'pine-stool-4471', '4471', NULL), (2, NULL, NULL, '', '', NULL), (3, NULL, NULL, '', '', NULL), (4, NULL, NULL, '', '', NULL), (5, NULL, NULL, '', '', NULL), (6, NULL, NULL, '', '', NULL), (7, NULL, NULL, '', '', NULL), (8, NULL, NULL, '', 'FB8', 'https://cdn.example.com/img/bag-2.jpg')) AS t(page_id, canonical, site, url_tokens, key_tokens, hints)""")
def pdp_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address, metas, tokens that identify the product, and preloaded images."""
    from shelfmark.operators import images

    parsed = parsed_pages(sample_pages(spark))
    dom, nodes = dom_nodes(parsed), json_nodes(parsed)
    ids = images.identities(parsed, dom, nodes)
    joined = ids.join(D.metas(dom, "site_name"), "page_id", "left").join(images.preload_hints(dom), "page_id", "left")
    return joined.select("page_id", F.col("base").alias("canonical"), F.col("meta_site_name").alias("site"), F.array_join("url_tokens", " ").alias("url_tokens"), F.array_join("key_tokens", " ").alias("key_tokens"), F.array_join("hints", " ").alias("hints"))


@query("""SELECT * FROM (VALUES (1, 89.0, 'EUR', 'false', 'true'), (2, 31.0, 'USD', 'true', NULL), (2, 31.0, NULL, 'false', 'false'), (2, 42.5, NULL, 'false', 'true'), (2, 39.0, 'USD', 'false', NULL), (3, 24.5, 'GBP', 'false', NULL), (4, 36.0, 'GBP', 'false', NULL), (5, 120.0, 'USD', 'false', NULL)) AS t(page_id, amount, currency, is_range, buyable)""")
def pdp_offer_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of offers with how they weigh; the delivery charge of page 1 is none."""
    from shelfmark.operators.fields import node_prices

    nodes = json_nodes(parsed_pages(sample_pages(spark)))
    return node_prices(graph.product_nodes(nodes).filter("rk = 1"), nodes).select("page_id", "amount", "currency", F.col("is_range").cast("string").alias("is_range"), F.col("buyable").cast("string").alias("buyable"))


@query("""SELECT * FROM (VALUES (1, true, 1, 1, true), (2, true, 1, 0, true), (3, true, 1, 0, true), (4, true, 1, 0, true), (5, true, 1, 0, true), (6, true, 1, 0, true), (7, true, 0, 0, true), (8, true, 1, 1, true)) AS t(page_id, has_facts, n_nodes, n_metas, has_text)""")
def pdp_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of evidence that a judgement made elsewhere would read."""
    from shelfmark.operators.evidence import bundle
    from shelfmark.plans.extract import facts

    parsed = staged(parsed_pages(sample_pages(spark)), "parsed")
    text = F.col("evidence")
    return bundle(facts(parsed), parsed).select(
        "page_id", text.contains("### already extracted").alias("has_facts"), (F.size(F.split(text, "### structured data ")) - 1).alias("n_nodes"),
        F.when(text.contains("### page metadata"), 1).otherwise(0).alias("n_metas"), text.contains("### visible page text").alias("has_text"),
    )


@query("""SELECT * FROM (VALUES (1, 'page-1.html       1.00 EUR   89.00     2     1     0  Furniture > Chairs > Stools'), (2, 'page-2.html       1.00 USD   39.00     1     1     0  Outdoor > Lighting > Head Lamps'), (3, 'page-3.html       1.00 GBP   24.50     2     3     2  Apparel > Hats > Caps'), (4, 'page-4.html       1.00 GBP   36.00     1     1     0  Kitchen > Serving > Jugs'), (5, 'page-5.html       0.90 USD  120.00     1     3     2  Apparel > Coats > Rain Coats'), (6, 'page-6.html       0.64    REFUSED   no price found in structured data, markup annotations or pag'), (7, 'page-7.html       0.07    REFUSED   name came from document metadata with no structured data: pa'), (8, 'page-8.html       1.00 USD  140.00     2     1     0  Apparel > Bags > Field Bags')) AS t(page_id, line)""")
def pdp_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(sample_results(spark))


@query("""SELECT * FROM (VALUES (26, 'Product:77.id', 'id', 'Product:77.id'), (26, 'Product:77.id.brand.best', '__ref', 'Product:77.id'), (26, 'Product:77.id.mediaId', 'id', 'Product:77.id.mediaId'), (26, 'Product:77.brand.best', 'id', 'Product:77.id'), (26, 'Product:77.brand.best.mediaId', 'id', 'Product:77.id.mediaId'), (26, 'Product:77.mediaId', 'id', 'Product:77.id.mediaId'), (26, 'Brand:5.id.best', 'id', 'Product:77.id'), (26, 'Brand:5.id.best.mediaId', 'id', 'Product:77.id.mediaId'), (26, 'Brand:5.best', 'id', 'Product:77.id'), (26, 'Brand:5.best.brand.best', '__ref', 'Product:77.id'), (26, 'Brand:5.best.mediaId', 'id', 'Product:77.id.mediaId'), (26, 'Media:9.id', 'id', 'Product:77.id.mediaId'), (26, 'Product:77.id.brand', 'id', 'Product:77.id.brand'), (26, 'Product:77.brand', 'id', 'Product:77.id.brand'), (26, 'Product:77.brand.best.brand', '__ref', 'Product:77.id.brand'), (26, 'Brand:5.id', 'id', 'Product:77.id.brand'), (26, 'Brand:5.id.best.brand', '__ref', 'Product:77.id.brand'), (26, 'Brand:5.best.brand', 'id', 'Product:77.id.brand')) AS t(page_id, from_path, k, to_path)""")
def pdp_reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that stay after following, those that would lead back into themselves, as edges between objects."""
    nodes = json_nodes(parsed_pages(framework_pages(spark)))
    return graph.reference_edges(nodes).join(nodes.select("page_id", F.col("n").alias("target"), F.col("path").alias("to_path")), ["page_id", "target"]).join(nodes.select("page_id", "n", F.col("path").alias("from_path")), ["page_id", "n"]).select("page_id", "from_path", "k", "to_path")


@query("""SELECT * FROM (VALUES ('', NULL), ('Product:77', 'Reed Basket'), ('Product:77.id', 'Reed Basket'), ('Product:77.id.brand', 'Marsh & Co'), ('Product:77.id.brand.best', NULL), ('Product:77.id.mediaId', 'https://cdn.example.com/img/basket.jpg'), ('Product:77.brand', 'Marsh & Co'), ('Product:77.brand.best', 'Reed Basket'), ('Product:77.brand.best.brand', NULL), ('Product:77.brand.best.mediaId', 'https://cdn.example.com/img/basket.jpg'), ('Product:77.mediaId', 'https://cdn.example.com/img/basket.jpg'), ('Brand:5', 'Marsh & Co'), ('Brand:5.id', 'Marsh & Co'), ('Brand:5.id.best', 'Reed Basket'), ('Brand:5.id.best.brand', NULL), ('Brand:5.id.best.mediaId', 'https://cdn.example.com/img/basket.jpg'), ('Brand:5.best', 'Reed Basket'), ('Brand:5.best.brand', 'Marsh & Co'), ('Brand:5.best.brand.best', NULL), ('Brand:5.best.mediaId', 'https://cdn.example.com/img/basket.jpg'), ('Media:9', 'https://cdn.example.com/img/basket.jpg'), ('Media:9.id', 'https://cdn.example.com/img/basket.jpg')) AS t(path, named)""")
def pdp_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the page whose data is a store of rows, with what their references have become."""
    nodes = json_nodes(parsed_pages(framework_pages(spark).filter("page_id = 26")))
    name = graph.string_of(graph.member("name"))
    return nodes.select("path", F.coalesce(name, graph.string_of(graph.member("url"))).alias("named"))


@query("""SELECT * FROM (VALUES (21, 'state:window.__STATE__', 2), (22, 'json-parse', 2), (23, 'attr:data-more', 1), (23, 'attr:data-product', 1), (24, 'script-literal', 4), (25, 'rdfa', 2), (26, 'script-json', 22), (27, 'script-json', 10), (28, 'script-json', 400)) AS t(page_id, carrier, n)""")
def pdp_framework_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_nodes(parsed_pages(framework_pages(spark))).groupBy("page_id", "carrier").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES (21, 'Oak Shelf', '', 75.0, 'EUR', 'One board of oak, two pins.', 'https://cdn.example.com/img/shelf.jpg', NULL, NULL), (22, 'Tin Mug', 'Campfire', 9.5, 'USD', 'Enamelled, chips with grace.', 'https://cdn.example.com/img/mug.jpg', NULL, NULL), (23, 'Felt Hat', 'Brim', 44.0, 'GBP', '', 'https://cdn.example.com/img/hat.jpg', NULL, NULL), (24, 'Rope Mat', 'Quay', 30.0, 'USD', '', 'https://cdn.example.com/img/mat.jpg', NULL, NULL), (25, 'Salt Jar', 'Saltern', 18.0, 'EUR', 'Cork lid, no glaze inside.', 'https://cdn.example.com/img/jar.jpg', NULL, NULL), (26, 'Reed Basket', 'Marsh & Co', 52.0, 'USD', 'Woven tight enough for seed.', 'https://cdn.example.com/img/basket.jpg', NULL, NULL), (27, 'Trail Sock', 'Footpath', 14.0, 'USD', 'Ribbed merino, knitted double at heel and toe.', 'https://cdn.example.com/img/trail-sock-88-a.jpg https://cdn.example.com/img/trail-sock-88-b.jpg', 'https://clips.example.com/v/trail-sock-88.mp4', NULL)) AS t(page_id, name, brand, price, currency, description, images, video, refused)""")
def pdp_framework_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("product")
    return framework_results(spark).select("page_id", p["name"].alias("name"), p["brand"].alias("brand"), p["price"]["price"].alias("price"), p["price"]["currency"].alias("currency"), p["description"].alias("description"), F.array_join(p["image_urls"], " ").alias("images"), p["video_url"].alias("video"), "refused").filter("page_id < 28")


@query("""SELECT * FROM (VALUES (27, '88-1', 'Color=Moss,Size=S', 14.0, 'https://cdn.example.com/img/moss.jpg', 'in_stock'), (27, '88-2', 'Color=Clay,Size=M', 15.0, 'https://cdn.example.com/img/clay.jpg', 'out_of_stock')) AS t(page_id, sku, options, price, images, availability)""")
def pdp_framework_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name their options as a list of pairs and as a map, with images and stock of their own."""
    rows = framework_results(spark).filter("page_id = 27").select("page_id", F.explode("product.variants").alias("v"))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("v.options"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.select("page_id", "v.sku", told.alias("options"), F.col("v.price.price").alias("price"), F.array_join("v.image_urls", " ").alias("images"), "v.availability")


@query("SELECT 28 AS page_id, CAST(200 AS BIGINT) AS n")
def pdp_many_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image candidates of a page with two hundred JSON scripts, in the order of the page."""
    from shelfmark.operators import images

    parsed = staged(parsed_pages(framework_pages(spark).filter("page_id = 28")), "parsed")
    dom, nodes, strings = dom_nodes(parsed), json_nodes(parsed), json_strings(parsed)
    found = images.candidates(dom, nodes, strings, images.identities(parsed, dom, nodes))
    listed = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("xs"))
    in_order = F.forall(F.transform("xs", lambda x, i: x["url"].endswith(F.concat(F.lit("bolt-"), i.cast("string"), F.lit(".jpg")))), lambda ok: ok)
    return listed.filter(in_order).select("page_id", F.size("xs").cast("long").alias("n"))
