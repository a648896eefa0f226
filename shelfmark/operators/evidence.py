"""The bundle of evidence for judgements that are made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.operators.dom import attribute, visible_text
from shelfmark.operators.graph import product_nodes
from shelfmark.sources.pages import dom_nodes, json_nodes

MOST_NODES, MOST_META, MOST_IMAGES, SAME_PREFIX = 3, 900, 30, 400


def bundle(facts: DataFrame, parsed: DataFrame, dom: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``evidence``: what is known, the best objects, metas, image names, visible text.

    ``facts`` as from :func:`shelfmark.plans.extract.facts`; the size of each part is bounded.
    ``dom`` and ``products`` are those of ``parsed`` where they are written already.
    """
    dom = dom_nodes(parsed) if dom is None else dom
    products = product_nodes(json_nodes(parsed)) if products is None else products
    axes = F.transform("options", lambda o: F.struct(o["name"].alias("name"), F.slice(o["values"], 1, 6).alias("values")))
    trail = F.nullif(F.array_join("trail", " > "), F.lit(""))
    known = F.to_json(F.struct("name", "brand", "price", "currency", trail.alias("breadcrumb"), F.when(F.size("options") > 0, axes).alias("variant_axes")))
    best = products.filter((F.col("rk") <= MOST_NODES) & F.col("pruned").isNotNull())
    shown = F.concat(F.lit("### structured data (rank "), F.col("rk").cast("string"), F.lit(", score "), F.col("score").cast("string"), F.lit(")\n"), "pruned")
    first = best.groupBy("page_id", F.substring("pruned", 1, SAME_PREFIX).alias("same")).agg(F.min(F.struct("rk", shown.alias("t"))).alias("x"))
    objects = first.groupBy("page_id").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("page_id", F.transform("xs", lambda x: x["t"]).alias("objects"))
    tags = dom.filter("tag = 'meta'").select("page_id", "nid", F.coalesce(F.nullif(attribute("property"), F.lit("")), attribute("name")).alias("key"), attribute("content").alias("content"))
    lines = tags.filter("key <> '' and content <> ''").filter(F.col("key").rlike(P.META_SHOWN)).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("nid", F.concat("key", F.lit(": "), F.substring("content", 1, 240)).alias("t")))).alias("ms"))
    metas = lines.select("page_id", F.concat(F.lit("### page metadata\n"), F.substring(F.array_join(F.transform("ms", lambda m: m["t"]), "\n"), 1, MOST_META)).alias("metas"))
    names = F.transform(F.slice("image_urls", 1, MOST_IMAGES), lambda u, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.substring(F.regexp_extract(F.regexp_replace(u, r"[?#].*$", ""), r"[^/]*$", 0), 1, 70)))
    pictures = F.when(F.size("image_urls") > 0, F.concat(F.lit("### candidate images (refer to these by index)\n"), F.array_join(names, "\n")))
    joined = facts.join(objects, "page_id", "left").join(metas, "page_id", "left").join(parsed.select("page_id", "html"), "page_id", "left")
    parts = F.concat(
        F.array(F.concat(F.lit("### already extracted (treat as given; do not restate)\n"), known)), F.coalesce("objects", F.array().cast("array<string>")),
        F.array(F.col("metas"), pictures, F.concat(F.lit("### visible page text\n"), visible_text(F.coalesce("html", F.lit(""))))),
    )
    return joined.select("page_id", F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n").alias("evidence"))
