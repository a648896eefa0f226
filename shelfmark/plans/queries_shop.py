"""Queries over pages written from ``part`` and ``lineitem``, read back by the whole plan.

The SQL computes what must come out from the two tables alone; it knows what each page shape
states, not how it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import dom as D
from shelfmark.operators import evidence, fields, graph, images
from shelfmark.plans.extract import report
from shelfmark.plans.queries_text import query
from shelfmark.plans.shopfront import shop_run
from shelfmark.sources.catalog import entries
from shelfmark.sources.pages import json_strings

_PART = """p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % 12 AS shape, p_name || ' ' || p_partkey AS name, p_brand AS brand, p_type AS kind, CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
    'A ' || p_name || ' of type ' || p_type || ', number ' || p_size || ', kept on the shelf.' AS text, 'https://cdn.example.com/img/part-' || p_partkey AS img FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
v AS (SELECT CAST(l_partkey AS BIGINT) AS id, CASE l_returnflag WHEN 'A' THEN 'Amber' WHEN 'N' THEN 'Navy' ELSE 'Red' END AS color, l_linenumber AS line, 'S' || l_partkey || '-' || l_returnflag || l_linenumber AS sku,
    min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) % 2 = 1 AS sold FROM lineitem GROUP BY l_partkey, l_returnflag, l_linenumber)"""

_OFFERS = """o AS (SELECT id, coalesce(min(cents) FILTER (sold), min(cents)) AS cents, max(cents) AS most FROM v GROUP BY id)"""

_VARIED = (1, 3, 4, 5, 9)


def _pairs(options: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


@query(
    f"""WITH {_PART}, {_OFFERS}
    SELECT id AS page_id, name, CASE shape WHEN 2 THEN 'Shelf Shop' WHEN 9 THEN '' ELSE brand END AS brand, text AS description, (CASE shape WHEN 11 THEN o.cents ELSE p.cents END) / 100.0 AS price,
      CASE WHEN shape IN (0, 2, 7) THEN 'EUR' WHEN shape IN (1, 4, 6) THEN 'GBP' ELSE 'USD' END AS currency,
      CASE shape WHEN 0 THEN (p.cents + 2000) / 100.0 WHEN 11 THEN CASE WHEN o.most > o.cents AND o.most <= 10 * o.cents THEN o.most / 100.0 END END AS compare_at, 'https://shop.example.com/p/part-' || id AS url, CAST(NULL AS VARCHAR) AS refused
    FROM p JOIN o USING (id)"""
)
def shop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, brand, description, price, currency and compared price of every page, whatever carries them."""
    p = F.col("product")
    return shop_run(spark, sf_dir)["results"].select(
        "page_id", p["name"].alias("name"), p["brand"].alias("brand"), p["description"].alias("description"), p["price"]["price"].alias("price"), p["price"]["currency"].alias("currency"),
        p["price"]["compare_at_price"].alias("compare_at"), "url", "refused",
    )


@query(
    f"""WITH {_PART}
    SELECT id AS page_id, sku, 'Color=' || color || ',Size=L' || line AS options, CASE shape WHEN 9 THEN NULL ELSE v.cents / 100.0 END AS price, CASE shape WHEN 9 THEN NULL WHEN 4 THEN 'GBP' ELSE 'USD' END AS currency,
      CASE WHEN shape = 9 THEN 'unknown' WHEN sold THEN 'in_stock' ELSE 'out_of_stock' END AS availability, CASE shape WHEN 4 THEN img || '-' || lower(color) || '.jpg' ELSE '' END AS images
    FROM p JOIN v USING (id) WHERE shape IN {_VARIED} UNION ALL SELECT id, 'P' || id, '', NULL, NULL, 'unknown', '' FROM p WHERE shape NOT IN {_VARIED} AND shape <> 9"""
)
def shop_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant of every page: rows by position, by axis, with pairs, with maps, and articles that all axes leave."""
    rows = shop_run(spark, sf_dir)["results"].filter("product is not null").select("page_id", F.explode("product.variants").alias("v"))
    return rows.select("page_id", "v.sku", _pairs(F.col("v.options")).alias("options"), F.col("v.price.price").alias("price"), F.col("v.price.currency").alias("currency"), "v.availability", F.array_join("v.image_urls", " ").alias("images"))


@query(
    f"""WITH {_PART}, seen AS (SELECT id, color, line, row_number() OVER (PARTITION BY id ORDER BY color, line) AS spot FROM p JOIN v USING (id) WHERE shape IN {_VARIED}),
    colors AS (SELECT id, 'Color' AS axis, color AS value, min(spot) AS spot FROM seen GROUP BY id, color UNION ALL SELECT id, 'Color', 'Grey', 1000 FROM p WHERE shape = 9),
    sizes AS (SELECT id, 'Size' AS axis, 'L' || line AS value, CASE WHEN any_value(shape) = 9 THEN line ELSE min(spot) END AS spot FROM seen JOIN p USING (id) GROUP BY id, line)
    SELECT id AS page_id, axis, string_agg(value, '|' ORDER BY spot) AS choices FROM (FROM colors UNION ALL FROM sizes) GROUP BY id, axis"""
)
def shop_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes with their values in the order of the page."""
    rows = shop_run(spark, sf_dir)["results"].select("page_id", F.explode("product.options").alias("o"))
    return rows.select("page_id", F.col("o.name").alias("axis"), F.array_join("o.values", "|").alias("choices"))


@query(
    f"""WITH {_PART}, shades AS (SELECT id, string_agg(img || '-' || lower(color) || '.jpg', ' ' ORDER BY color) AS urls FROM p JOIN (SELECT DISTINCT id, color FROM v) USING (id) WHERE shape = 4 AND color <> 'Navy' GROUP BY id)
    SELECT id AS page_id, CASE shape WHEN 0 THEN img || '-a_1200x1200.jpg ' || img || '-b_1200x1200.jpg' WHEN 1 THEN img || '-a.jpg ' || img || '-b.jpg' WHEN 4 THEN img || '.jpg ' || urls
      WHEN 10 THEN img || '-2_1200x1200.jpg ' || img || '-1_1200x1200.jpg' ELSE img || '.jpg' END AS images, CASE shape WHEN 10 THEN 'https://cdn.example.com/v/part-' || id || '.mp4' END AS video FROM p LEFT JOIN shades USING (id)"""
)
def shop_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product's own pictures, preloaded first, each in its largest rendition, and its video.

    Words that exclude a picture match inside words: ``nav`` excludes what is called navy.
    """
    return shop_run(spark, sf_dir)["results"].select("page_id", F.array_join("product.image_urls", " ").alias("images"), F.col("product.video_url").alias("video"))


@query(
    f"""WITH {_PART}, n AS (SELECT id, count(*) AS n FROM v GROUP BY id)
    SELECT id AS page_id, CASE WHEN shape IN (0, 10, 11) THEN 'ld+json' WHEN shape = 1 THEN 'state:window.__STATE__' WHEN shape = 2 THEN 'state:window.__NUXT__' WHEN shape = 3 THEN 'json-parse' WHEN shape = 4 THEN 'attr:data-product'
        WHEN shape = 5 THEN 'script-literal' WHEN shape = 6 THEN 'microdata' WHEN shape = 7 THEN 'rdfa' ELSE 'script-json' END AS carrier,
      CASE shape WHEN 0 THEN 10 WHEN 1 THEN 2 + n WHEN 2 THEN 2 WHEN 3 THEN 2 + 3 * n WHEN 4 THEN 1 + 4 * n WHEN 5 THEN 4 + 2 * n WHEN 6 THEN 3 WHEN 7 THEN 2 WHEN 8 THEN 11 WHEN 10 THEN 1 WHEN 11 THEN 2 + n
        ELSE 5 + (SELECT count(DISTINCT color) + count(DISTINCT line) FROM v WHERE v.id = p.id) END AS n_objects FROM p JOIN n USING (id) UNION ALL SELECT id, 'attr:data-more', 1 FROM p WHERE shape = 4"""
)
def shop_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects each carrier gives, references followed."""
    return shop_run(spark, sf_dir)["objects"].groupBy("page_id", "carrier").agg(F.count("*").alias("n_objects"))


@query(
    f"""WITH {_PART} SELECT id AS page_id, 'Shelf Shop > ' || kind || ' > ' || name AS stated, CAST(NULL AS VARCHAR) AS shown FROM p WHERE shape = 0
    UNION ALL SELECT id, NULL, kind || ' > ' || name FROM p WHERE shape = 10"""
)
def shop_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails from annotated lists and from navigation elements."""
    run = shop_run(spark, sf_dir)
    stated = graph.graph_breadcrumbs(run["objects"]).select("page_id", F.array_join("trail", " > ").alias("stated"))
    return run.kept(stated.join(D.breadcrumbs(run["elements"]).select("page_id", F.array_join("trail", " > ").alias("shown")), "page_id", "full"), "shop-breadcrumbs")


@query(
    f"""WITH {_PART}, said AS (SELECT id, shape, unnest(CASE shape WHEN 6 THEN [['Product', 'name', name], ['Product', 'sku', 'P' || id], ['Product', 'brand', NULL], ['Brand', 'name', brand], ['Product', 'description', text], ['Product', 'image', img || '.jpg'],
      ['Product', 'offers', NULL], ['Offer', 'priceCurrency', 'GBP'], ['Offer', 'price', (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')]] ELSE [] END) AS x FROM p WHERE shape = 6)
    SELECT id AS page_id, x[1] AS scope_type, x[2] AS name, x[3] AS value FROM said"""
)
def shop_microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microdata as a join of element intervals."""
    run = shop_run(spark, sf_dir)
    return run.kept(D.annotations(run["elements"]).select("page_id", "scope_type", "name", "value"), "shop-microdata")


@query(f"WITH {_PART} SELECT id AS page_id, cents / 100.0 AS price, CASE shape WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE shape WHEN 0 THEN (cents + 2000) / 100.0 END AS compare_at FROM p WHERE shape IN (0, 10)")
def shop_dom_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money near the heading, without charges and other products."""
    run = shop_run(spark, sf_dir)
    found = run.kept(fields.dom_price(run["elements"]), "shop-dom-prices")
    return found.select("page_id", F.col("dom_price").alias("price"), F.col("dom_currency").alias("currency"), F.col("dom_compare").alias("compare_at"))


@query(
    f"""WITH {_PART}, r AS (SELECT id, min(cents) AS low FROM v GROUP BY id)
    SELECT id AS page_id, low / 100.0 AS amount, 'USD' AS currency, 'true' AS is_range, CAST(NULL AS VARCHAR) AS buyable FROM p JOIN r USING (id) WHERE shape = 11
    UNION ALL SELECT id, v.cents / 100.0, NULL, 'false', CAST(sold AS VARCHAR) FROM p JOIN v USING (id) WHERE shape = 11
    UNION ALL SELECT id, cents / 100.0, CASE WHEN shape IN (0, 2, 7) THEN 'EUR' WHEN shape IN (1, 4, 6) THEN 'GBP' ELSE 'USD' END, 'false', CASE shape WHEN 0 THEN 'true' END FROM p WHERE shape NOT IN (10, 11)"""
)
def shop_offer_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the first product of each page, of its offers or its own, with how they weigh; shipping charges are none."""
    run = shop_run(spark, sf_dir)
    found = run.kept(fields.node_prices(run["products"].filter("rk = 1"), run["objects"], run.buckets), "shop-offer-prices")
    return found.select("page_id", "amount", "currency", F.col("is_range").cast("string").alias("is_range"), F.col("buyable").cast("string").alias("buyable"))


@query(
    f"""WITH {_PART} SELECT id AS page_id, 'https://shop.example.com/p/part-' || id AS canonical, CASE WHEN shape IN (0, 2) THEN 'Shelf Shop' END AS site, 'part-' || id AS url_tokens,
      CASE WHEN shape IN (0, 2) THEN 'Shelf Shop' END IS NOT NULL AS has_site, CASE shape WHEN 10 THEN img || '-2.jpg' END AS hints FROM p"""
)
def shop_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address, site name, the address's own token and preloaded pictures."""
    run = shop_run(spark, sf_dir)
    dom = run["elements"]
    joined = run.kept(run["pages"].select("page_id").join(images.page_urls(dom), "page_id", "left").join(D.metas(dom, "site_name"), "page_id", "left").join(images.preload_hints(dom), "page_id", "left"), "shop-identity")
    return joined.select("page_id", F.col("base").alias("canonical"), F.col("meta_site_name").alias("site"), F.coalesce(F.array_join("url_tokens", " "), F.lit("")).alias("url_tokens"), F.col("meta_site_name").isNotNull().alias("has_site"), F.array_join("hints", " ").alias("hints"))


@query(
    f"""WITH {_PART}, {_OFFERS}, n AS (SELECT id, count(*) AS n FROM v GROUP BY id), c AS (SELECT p.*, CASE shape WHEN 11 THEN o.cents ELSE p.cents END AS shown, n.n, CASE WHEN shape IN (0, 1, 10) THEN 2 WHEN shape = 4 THEN 1 + (SELECT count(DISTINCT color) FILTER (color <> 'Navy') FROM v WHERE v.id = p.id) ELSE 1 END AS pics FROM p JOIN o USING (id) JOIN n USING (id))
    SELECT id AS page_id, rpad('part-' || id || '.html', 16, ' ') || CASE shape WHEN 9 THEN '  0.90 ' ELSE '  1.00 ' END || CASE WHEN shape IN (0, 2, 7) THEN 'EUR' WHEN shape IN (1, 4, 6) THEN 'GBP' ELSE 'USD' END || ' ' || lpad(format('{{:,.2f}}', shown / 100.0), CAST(greatest(7, length(format('{{:,.2f}}', shown / 100.0))) AS INTEGER), ' ')
      || ' ' || lpad(CAST(pics AS VARCHAR), 5, ' ') || ' ' || lpad(CAST(CASE WHEN shape IN {_VARIED} THEN n ELSE 1 END AS VARCHAR), 5, ' ') || ' ' || lpad(CASE WHEN shape IN {_VARIED} THEN '2' ELSE '0' END, 5, ' ') AS line FROM c"""
)
def shop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The console line of each page, up to its category."""
    return report(shop_run(spark, sf_dir)["results"]).select("page_id", F.regexp_replace("line", "  Hardware > .*$", "").alias("line"))


@query(f"WITH {_PART} SELECT trim(regexp_replace(lower(CASE WHEN shape = 2 THEN 'Shelf Shop' WHEN shape = 9 THEN '' ELSE brand END || '-' || name), '[^a-z0-9]+', '-', 'g'), '-') AS id, count(*) AS n FROM p GROUP BY 1")
def shop_catalog_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the catalog made from the pages; equal ids are not merged."""
    return entries(shop_run(spark, sf_dir)["results"]).groupBy("id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_PART} SELECT id AS page_id, true AS has_facts, true AS names_it, true AS has_nodes, shape IN (0, 2, 7, 10) AS has_metas, true AS has_text FROM p"""
)
def shop_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of evidence of each page: facts, the objects' JSON, metas, and the visible text."""
    run = shop_run(spark, sf_dir)
    text = F.col("evidence")
    told = run.kept(evidence.bundle(run["facts"], run["parsed"], run["elements"], run["products"]).join(run["facts"].select("page_id", "name"), "page_id"), "shop-evidence")
    return told.select("page_id", text.contains("### already extracted").alias("has_facts"), text.contains(F.col("name")).alias("names_it"), text.contains("### structured data ").alias("has_nodes"), text.contains("### page metadata").alias("has_metas"), text.contains("### visible page text").alias("has_text"))


@query(f"""WITH {_PART} SELECT id AS page_id, 'Product:' || id AS product, brand, img || '.jpg' AS picture FROM p WHERE shape = 8""")
def shop_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of rows after its references are followed: the product holds its brand and its picture."""
    nodes = shop_run(spark, sf_dir)["objects"].filter("carrier = 'script-json'")
    name, url = graph.string_of(graph.member("name")), graph.string_of(graph.member("url"))
    held = nodes.filter(F.col("path").rlike(r"^Product:\d+\.(?:brand|mediaId)$")).select("page_id", F.element_at(F.split("path", r"\."), 1).alias("product"), "parent_key", F.coalesce(name, url).alias("v"))
    return held.groupBy("page_id", "product").agg(F.min(F.when(F.col("parent_key") == "brand", F.col("v"))).alias("brand"), F.min(F.when(F.col("parent_key") == "mediaId", F.col("v"))).alias("picture"))


@query(
    f"""WITH {_PART}, r AS (SELECT id, sold, row_number() OVER (PARTITION BY id ORDER BY color, line) - 1 AS spot FROM v), s AS (SELECT id, coalesce(min(spot) FILTER (sold), 0) AS spot FROM r GROUP BY id),
    f AS (SELECT id, unnest([['name', CASE shape WHEN 1 THEN 'json:product.name' WHEN 2 THEN 'json:product.name' WHEN 3 THEN 'json:product.name' WHEN 5 THEN 'json:[3].product.name' WHEN 8 THEN 'json:Product:' || id || '.name' WHEN 9 THEN 'json:item.name' ELSE 'json:name' END],
      ['price', CASE shape WHEN 0 THEN 'json:offers.price+dom:compare-at' WHEN 5 THEN 'json:[3].product.offers.price' WHEN 6 THEN 'json:offers.price' WHEN 7 THEN 'json:offers.price' WHEN 8 THEN 'json:Product:' || id || '.price' WHEN 9 THEN 'json:item.price' WHEN 10 THEN 'dom:product-scope'
        WHEN 4 THEN 'json:price' WHEN 11 THEN 'json:offers.offers[' || s.spot || '].price' ELSE 'json:product.price' END]]) AS x FROM p JOIN s USING (id)) SELECT id AS page_id, x[1] AS field, x[2] AS origin FROM f"""
)
def shop_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where name and price of each page came from; of a range of offers the price is said to be of the first not sold out."""
    rows = shop_run(spark, sf_dir)["results"].select("page_id", F.explode("field_sources").alias("field", "origin"))
    return rows.filter("field in ('name', 'price')")


@query(
    f"""WITH {_PART} SELECT id AS page_id, unnest(CASE shape WHEN 0 THEN [img || '-a_1200x1200.jpg', img || '-b_1200x1200.jpg'] WHEN 1 THEN [img || '-a.jpg', img || '-b.jpg'] WHEN 5 THEN [img || '.jpg'] END) AS url,
      unnest(CASE shape WHEN 0 THEN [0, 1] WHEN 1 THEN [0, 1] WHEN 5 THEN [0] END) AS at FROM p WHERE shape IN (0, 1, 5)"""
)
def shop_listed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image addresses that are elements of lists, in the order of the page."""
    found = json_strings(shop_run(spark, sf_dir)["parsed"]).filter("s like 'https://cdn.example.com/img/%'")
    listed = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("xs"))
    return listed.select("page_id", F.posexplode("xs").alias("at", "x")).select("page_id", F.col("x.s").alias("url"), "at")


@query(
    f"""WITH {_PART}, n AS (SELECT id, count(*) AS n FROM v GROUP BY id) SELECT id AS page_id, 'product' AS path, CASE shape WHEN 1 THEN 9 ELSE 8 END AS n_members, name FROM p WHERE shape IN (1, 3)"""
)
def sql_harvest_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of product objects by the table function, in SQL alone."""
    from shelfmark.sources.sql import register

    register(spark)
    shop_run(spark, sf_dir)["pages"].createOrReplaceTempView("shop_pages")
    return spark.sql("SELECT p.page_id, h.path, count(*) AS n_members, max(h.value) FILTER (WHERE h.k = 'name') AS name FROM shop_pages p, LATERAL harvest_blobs(p.html) h WHERE h.path = 'product' AND p.page_id % 12 IN (1, 3) GROUP BY p.page_id, h.path")
