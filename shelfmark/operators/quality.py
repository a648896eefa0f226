"""How far a page can be trusted: warnings, confidence, refusal; and judgements on supplied answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.text import strip
from shelfmark.operators.graph import declared_type

UNRENDERED = "name came from document metadata with no structured data: page may not have rendered"
NO_PRICE = "no price found in structured data, markup annotations or page text"
NO_IMAGES = "no images resolved"
NO_DESCRIPTION = "no description found"
LIST_MEMBER = "product fields resolved from an itemListElement: not a PDP"
LEXICAL = "category resolved lexically: no model response"
LISTING_FROM = 8
FLOOR = 0.35


def product_counts(products: DataFrame) -> DataFrame:
    """``page_id``, ``n_nodes``, ``n_products``: product-shaped objects, and those that declare a product type."""
    return products.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.count_if(declared_type().isin("product", "productgroup")).alias("n_products"))


def page_warnings(has_nodes: Column, name_src: Column, price: Column, image_urls: Column, description: Column, n_products: Column, can_buy: Column, og_type: Column, lists: Column, sources: Column) -> Column:
    """Reasons to distrust a page, in a fixed order.

    ``can_buy``: the page has words of buying; ``lists``: it declares a listing type; ``sources``:
    array of where its fields came from.
    """
    meta_name = F.coalesce(name_src.startswith("dom:title") | name_src.startswith("meta:"), F.lit(False))
    og = F.lower(strip(F.coalesce(og_type, F.lit(""))))
    listing = F.concat(n_products.cast("string"), F.lit(" product nodes and no buy affordance: looks like a listing page"))
    declared = F.concat(F.lit("page declares og:type='"), og, F.lit("' and a listing page type: not a PDP"))
    told = [
        F.when(meta_name & ~has_nodes, UNRENDERED), F.when(price.isNull(), NO_PRICE), F.when(F.coalesce(F.size(image_urls), F.lit(0)) <= 0, NO_IMAGES),
        F.when(F.coalesce(description, F.lit("")) == "", NO_DESCRIPTION), F.when((n_products >= LISTING_FROM) & ~can_buy, listing),
        F.when((og != "") & ~og.isin(*P.PRODUCT_OG_TYPES) & lists, declared), F.when(F.exists(sources, lambda s: F.coalesce(s.contains("itemListElement"), F.lit(False))), LIST_MEMBER),
    ]
    return F.filter(F.array(*told), lambda w: w.isNotNull())


def confidence(name: Column, price: Column, image_urls: Column, brand: Column, description: Column, trail: Column, has_nodes: Column, sources: Column, warnings: Column) -> Column:
    """0 to 1, three digits: :func:`weighed`, rounded."""
    return F.round(weighed(name, price, image_urls, brand, description, trail, has_nodes, sources, warnings), 3)


def weighed(name: Column, price: Column, image_urls: Column, brand: Column, description: Column, trail: Column, has_nodes: Column, sources: Column, warnings: Column) -> Column:
    """0 to 1: weights of what was found, less for each warning."""

    def given(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    def filled(c: Column) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) > 0

    # In whole percents, as sums of such fractions are inexact.
    parts = ((given(name), 30), (price.isNotNull(), 25), (filled(image_urls), 15), (given(brand), 10), (given(description), 10), (filled(trail), 5), (has_nodes, 5))
    total = F.lit(0)
    for test, weight in parts:
        total = total + F.when(test, weight).otherwise(0)
    structured = F.exists(sources, lambda s: F.coalesce(s.startswith("json"), F.lit(False)))
    total = F.when(structured, F.least(F.lit(100), total + 5)).otherwise(total)
    grave = F.size(F.filter(warnings, lambda w: w.contains("may not have rendered") | w.contains("listing page")))
    scaled = total / 100 * F.pow(F.lit(0.4), grave) * F.pow(F.lit(0.85), F.size(warnings) - grave)
    return F.least(scaled, F.lit(1.0))


def refusal(warnings: Column, price: Column, score: Column, mode: str = "full", floor: float = FLOOR) -> Column:
    """Why no record is made of a page, or null.  ``mode='deterministic'`` refuses for want of a price only."""
    categorical = F.exists(warnings, lambda w: w.contains("not a PDP") | w.contains("may not have rendered"))
    if mode == "deterministic":
        return F.when(price.isNull(), "price")
    return F.when(categorical, "categorical").when(price.isNull(), "price").when(score < floor, "confidence")


def image_judgement(image_urls: Column, indices: Column, window: int = 30) -> Column:
    """Images less those a supplied judgement drops; judgements that drop over a quarter are not believed."""
    judged, unseen = F.slice(image_urls, 1, window), F.filter(image_urls, lambda u, i: i >= window)
    kept = F.filter(judged, lambda u, i: F.array_contains(indices, i))
    enough = F.size(kept) >= F.greatest(F.lit(1), F.floor(F.size(judged) * 0.75).cast("int"))
    asked = (F.coalesce(F.size(indices), F.lit(0)) > 0) & (F.coalesce(F.size(image_urls), F.lit(0)) > 0)
    return F.when(asked & enough, F.concat(kept, unseen)).otherwise(image_urls)


def axis_renames(pairs: Column, names: Column) -> Column:
    """Accepted renames of axes: a map from the page's word to the better one.

    ``pairs``: array of structs ``original``, ``normalized``; ``names``: the page's axes.  A rename of
    more than two words or 24 characters, with separators, or onto another name is refused.
    """
    start = F.array().cast("array<struct<k: string, v: string>>")

    def add(taken: Column, p: Column) -> Column:
        source, target = strip(p["original"]), strip(p["normalized"])
        words = F.size(F.regexp_extract_all(target, F.lit(r"(\S+)"), F.lit(1)))
        sound = (source != "") & (target != "") & (source != target) & ~target.rlike(P.BAD_AXIS_NAME) & (words <= 2) & (F.length(target) <= 24)
        clash = F.exists(names, lambda n: (n != source) & (F.lower(n) == F.lower(target))) | F.exists(taken, lambda t: F.lower(t["v"]) == F.lower(target))
        rest = F.filter(taken, lambda t: t["k"] != source)
        return F.when(F.coalesce(sound & ~clash, F.lit(False)), F.concat(rest, F.array(F.struct(source.alias("k"), target.alias("v"))))).otherwise(taken)

    return F.map_from_entries(F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<original: string, normalized: string>>")), start, add))
