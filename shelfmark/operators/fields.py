"""Scalar fields, each by its own chain of priorities over all product-shaped objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.binding import let
from shelfmark.functions.money import amount_of_value, currency_of, money_mentions
from shelfmark.functions.text import clean_text, drop_title_suffix
from shelfmark.operators import dom as D
from shelfmark.operators.graph import cleaned, first_said, has_any, held_as, inside, member, present, string_of
from shelfmark.sources.stages import reused


def first_valid(candidates: Column, least: int) -> Column:
    """The first of an array of structs of value ``v`` and key ``k`` whose value is long enough; null if none is."""
    return F.try_element_at(F.filter(candidates, lambda r: F.length(r["v"]) >= least), F.lit(1))


def _origin(key: Column) -> Column:
    return F.concat(F.lit("json:"), F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), key)


def first_from_nodes(products: DataFrame, keys: tuple[str, ...], name: str, least: int = 1) -> DataFrame:
    """``page_id``, ``name``, ``name_src``: node by node in rank, key by key, the first usable text."""
    texts = F.transform(present(keys), lambda r: F.struct(cleaned(r["m"]).alias("v"), r["k"].alias("k")))
    got = products.select("page_id", "rk", "path", first_valid(texts, least).alias("x"))
    # Left out after grouping: a filter on the text would read it twice.
    best = got.groupBy("page_id").agg(F.min_by(F.struct("x.v", _origin(F.col("x.k")).alias("src")), F.when(F.col("x").isNotNull(), F.col("rk"))).alias("y")).filter("y is not null")
    return best.select("page_id", F.col("y.v").alias(name), F.col("y.src").alias(f"{name}_src"))


def brands(products: DataFrame, nodes: DataFrame) -> DataFrame:
    """Brand from the products: text, or the name of the object (or of the list's first entry) found there."""
    said = products.select("page_id", "rk", "path", F.inline(present(P.BRAND_KEYS)))
    first = F.when(F.col("m.kind") == "list", F.try_element_at("m.items", F.lit(1)))
    child = F.coalesce(F.col("m.child"), first["child"])
    own = F.when(F.col("m.kind") == "list", cleaned(first)).otherwise(cleaned(F.col("m")))
    objects = held_as(nodes, *P.BRAND_KEYS).select("page_id", F.col("n").alias("child"), F.coalesce(cleaned(member("name")), cleaned(member("brand")), cleaned(member("title"))).alias("named"))
    full = said.select("page_id", "rk", "path", "key_ord", "k", own.alias("own"), child.alias("child")).join(objects, ["page_id", "child"], "left")
    valid = full.withColumn("v", F.coalesce("own", "named")).filter((F.length("v") >= 1) & (F.length("v") < 80))
    best = valid.groupBy("page_id").agg(F.min_by(F.struct("v", _origin(F.col("k")).alias("src")), F.struct("rk", "key_ord")).alias("y"))
    return best.select("page_id", F.col("y.v").alias("brand"), F.col("y.src").alias("brand_src"))


def _state() -> Column:
    """Whether an offer can be bought: null if it does not say."""

    def one(m: Column) -> Column:
        return F.when(m["kind"] == "bool", m["s"] == "true").when((m["kind"] == "str") & (F.trim(m["s"]) != ""), ~m["s"].rlike(P.NOT_BUYABLE))

    return first_said(P.STOCK_STATE_KEYS, one)


def _currency() -> Column:
    return first_said(P.CURRENCY_KEYS, lambda m: currency_of(string_of(m)))


def _prices() -> Column:
    """The object's price members that are amounts, in order of preference."""
    rows = F.transform(present(P.PRICE_KEYS), lambda r: F.struct(r["k"].alias("k"), let(r["m"], lambda m: amount_of_value(m["kind"], m["s"], m["num"])).alias("amount")))
    return F.filter(rows, lambda r: r["amount"].isNotNull())


def held_by(products: DataFrame, nodes: DataFrame, *carried: str) -> DataFrame:
    """Objects inside each product (itself included) with their path relative to it, by interval of numbers.

    What is asked of an object is best computed before: it lies in several products at once.
    """
    p = products.select("page_id", "rk", F.col("b").alias("pb"), F.col("n").alias("pn"), F.col("last").alias("pl"), F.col("path").alias("product_path"), *carried)
    inner = inside(p, nodes, "pn", "pl")
    cut = F.when(F.col("product_path") == "", F.col("path")).otherwise(F.expr("substring(path, length(product_path) + 2)"))
    return inner.withColumn("rel", F.when(F.col("n") == F.col("pn"), "").otherwise(cut))


def node_prices(products: DataFrame, nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Prices of each product: of its offers, or of itself if those give none.

    ``page_id``, ``rk``, ``ord``, ``amount``, ``currency``, ``place``, ``is_range``, ``buyable``.
    """

    def truthy(key: str) -> Column:
        return let(member(key), lambda m: _filled(m, key))

    def _filled(m: Column, key: str) -> Column:
        return F.when((m["kind"] == "obj") | ((m["kind"] == "list") & (F.size(m["items"]) > 0)) | ((m["kind"] == "str") & (m["s"] != "")) | (m["kind"].isin("num", "bool") & ~m["s"].isin("0", "0.0", "false")), F.lit(key))

    source = F.coalesce(truthy("offers"), truthy("offer"), truthy("hasVariant"))
    kind = F.coalesce(F.nullif(string_of(member("@type")), F.lit("")), string_of(member("type")))
    charged = F.coalesce(kind.rlike(P.CHARGE_TYPE), F.lit(False))
    priced = nodes.filter(has_any(P.PRICE_KEYS)).select("page_id", "n", "path", F.explode_outer(F.slice(_prices(), 1, 1)).alias("x"), _currency().alias("currency"), _state().alias("buyable"), charged.alias("charged")).filter("x is not null and not charged")
    inner = held_by(products.withColumn("src_key", source).filter("src_key is not null"), priced, "src_key")
    below = inner.filter((F.col("rel") == F.col("src_key")) | F.col("rel").startswith(F.concat("src_key", F.lit("."))) | F.col("rel").startswith(F.concat("src_key", F.lit("["))))
    sub = F.regexp_replace(F.expr("substring(rel, length(src_key) + 1)"), r"^\.", "")
    offers = below.withColumn("sub", sub).filter(~F.col("sub").rlike(P.CHARGE_PATH))
    place = F.concat(F.lit("offers."), F.when(F.col("sub") != "", F.concat("sub", F.lit("."))).otherwise(""), F.col("x.k"))
    cols = ["page_id", "rk", "ord", "amount", "currency", "place", "is_range", "buyable"]
    of_offers = offers.select("page_id", "rk", F.struct("n", F.lit(0)).alias("ord"), F.col("x.amount").alias("amount"), "currency", place.alias("place"), F.lower("x.k").isin(*P.RANGE_KEYS).alias("is_range"), "buyable")
    of_offers = reused(of_offers, "offer-prices", buckets)
    own = products.select("page_id", "rk", "n", _currency().alias("currency"), _state().alias("buyable"), F.posexplode(_prices()).alias("i", "x"))
    of_self = own.select("page_id", "rk", F.struct("n", F.col("i").alias("col2")).alias("ord"), F.col("x.amount").alias("amount"), "currency", F.col("x.k").alias("place"), F.lower("x.k").isin(*P.RANGE_KEYS).alias("is_range"), "buyable")
    alone = of_self.join(of_offers.select("page_id", "rk").distinct(), ["page_id", "rk"], "left_anti")
    return of_offers.select(*cols).union(alone.select(*cols))


def compare_at(products: DataFrame, nodes: DataFrame) -> DataFrame:
    """Amounts under was-price names anywhere in each product: ``page_id``, ``rk``, ``amount``."""

    def was_price(m: Column) -> Column:
        # The pattern is asked of few names: all that it finds have one of these words.
        return let(F.lower(m["k"]), lambda k: k.contains("price") | k.contains("msrp")) & m["k"].rlike(P.WAS_PRICE_KEY)

    named = F.transform(F.filter("kv", was_price), lambda m: amount_of_value(m["kind"], m["s"], m["num"]))
    was = nodes.filter(F.exists("kv", was_price)).select("page_id", "n", "path", F.array_compact(named).alias("amounts"))
    return held_by(products, was).select("page_id", "rk", F.explode("amounts").alias("amount"))


def choose_price(prices: DataFrame) -> DataFrame:
    """``page_id``, ``rk``, ``price``, ``currency``, ``place`` from rows like those of :func:`node_prices`.

    Of the first product with prices, concrete ones before ends of a range, then buyable ones before
    others, each only if there are any; the lowest of what is left.
    """
    first = prices.groupBy("page_id").agg(F.min("rk").alias("rk"))
    rows = F.sort_array(F.collect_list(F.struct("ord", "amount", "currency", "place", "is_range", "buyable")))
    found = prices.join(first, ["page_id", "rk"]).groupBy("page_id", "rk").agg(rows.alias("found"))
    found = found.withColumn("found", let(F.filter("found", lambda r: ~r["is_range"]), lambda xs: F.when(F.size(xs) > 0, xs).otherwise(F.col("found"))))
    found = found.withColumn("found", let(F.filter("found", lambda r: F.coalesce(r["buyable"], F.lit(True))), lambda xs: F.when(F.size(xs) > 0, xs).otherwise(F.col("found"))))
    stated = F.filter(F.transform("found", lambda r: r["currency"]), lambda c: c.isNotNull())
    return found.select(
        "page_id", "rk", F.array_min(F.transform("found", lambda r: r["amount"])).alias("price"),
        F.try_element_at(stated, F.lit(1)).alias("currency"), F.element_at("found", 1)["place"].alias("place"),
    )


def graph_price(products: DataFrame, nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """``page_id``, ``price``, ``currency``, ``compare``, ``price_src`` of the first product with prices.

    Of its prices concrete ones go before ends of a range and buyable ones before others, each only
    if there are any; the lowest of those is the price, and the lowest was-price up to ten times it
    the compared one.
    """
    head = choose_price(reused(node_prices(products, nodes, buckets), "prices", buckets))
    was = compare_at(products, nodes).withColumnRenamed("amount", "was")
    credible = head.join(was, ["page_id", "rk"]).filter("was > price and was <= price * 10").groupBy("page_id").agg(F.min("was").alias("compare"))
    named = head.join(products.select("page_id", "rk", "path"), ["page_id", "rk"])
    return named.join(credible, "page_id", "left").select("page_id", "price", "currency", "compare", _origin(F.col("place")).alias("price_src"))


def dom_price(dom: DataFrame) -> DataFrame:
    """``page_id``, ``dom_price``, ``dom_currency``, ``dom_compare``: money near the page's heading.

    Elements in the heading's surroundings are read unless their context names other products or
    (without price words of their own) other charges; those that share the nearest ancestor with the
    heading count.
    """
    box = D.product_container(dom)
    boxes = dom.select("page_id", F.col("nid").alias("container"), F.col("last").alias("box_last")).join(box, ["page_id", "container"])
    own_words = F.lower(F.concat_ws(" ", *[F.concat(F.lit(f"{k}:"), D.attribute(k)) for k in ("class", "id", "data-testid", "aria-label")]))
    texts = dom.filter(~F.col("tag").isin("script", "style", "noscript", "template") & F.col("own_text").rlike(r"\S")).withColumn("own_words", own_words)
    pricey = F.col("own_words").rlike(P.PRICE_CONTEXT)
    kept = texts.filter(~F.col("ctx6").rlike(P.PLACEHOLDER) & ~F.col("ctx6").rlike(P.HARD_CONTEXT) & (~F.col("ctx6").rlike(P.SOFT_CONTEXT) | pricey))
    near = kept.join(boxes, "page_id").filter("nid >= container and nid <= box_last")
    shared = F.array_position("h1_anc", F.try_element_at(F.array_intersect("h1_anc", "anc"), F.lit(1))) - 1
    money = near.select("page_id", "nid", (F.coalesce(shared, F.lit(99)) + F.when(pricey, 0).otherwise(2)).alias("distance"), F.posexplode(money_mentions(F.col("own_text"))).alias("i", "m"))
    nearest = money.groupBy("page_id").agg(F.min("distance").alias("distance"))
    tight = money.join(nearest, ["page_id", "distance"]).groupBy("page_id").agg(
        F.min("m.amount").alias("dom_price"), F.max("m.amount").alias("most"), F.min_by(F.col("m.currency"), F.when(F.col("m.currency").isNotNull(), F.struct("nid", "i"))).alias("dom_currency")
    )
    return tight.select("page_id", "dom_price", "dom_currency", F.when(F.col("most") > F.col("dom_price"), F.col("most")).alias("dom_compare"))


def resolve(parsed: DataFrame, dom: DataFrame, nodes: DataFrame, products: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per page: name, brand, description, price, currency, compare_at_price and where each came from."""
    meta = D.metas(dom, "title", "site_name", "description")
    heads = D.title(dom)
    joined = parsed.select("page_id")
    for part in (
        first_from_nodes(products, P.NAME_KEYS, "name", 2), brands(products, nodes), first_from_nodes(products, P.DESCRIPTION_KEYS, "description", 24),
        graph_price(products, nodes, buckets), reused(dom_price(dom), "dom-prices", buckets), meta, heads,
    ):
        joined = joined.join(part, "page_id", "left")
    og_name, og_text, site = (clean_text(F.col(c)) for c in ("meta_title", "meta_description", "meta_site_name"))
    plain_title = clean_text(F.col("title"))
    from_title = F.coalesce(F.nullif(drop_title_suffix(plain_title), F.lit("")), plain_title)
    adopted = F.col("compare").isNull() & (F.col("dom_price") == F.col("price"))
    no_json = F.col("price").isNull()
    compare = F.when(no_json, F.col("dom_compare")).when(adopted, F.col("dom_compare")).otherwise(F.col("compare"))
    source = F.when(no_json, F.when(F.col("dom_price").isNotNull(), "dom:product-scope")).when(adopted & F.col("dom_compare").isNotNull(), F.concat("price_src", F.lit("+dom:compare-at"))).otherwise(F.col("price_src"))
    return joined.select(
        "page_id",
        F.coalesce("name", og_name, from_title).alias("name"),
        F.coalesce("name_src", F.when(og_name.isNotNull(), "meta:og:title"), F.when(from_title.isNotNull(), "dom:title")).alias("name_src"),
        F.coalesce("brand", site).alias("brand"),
        F.coalesce("brand_src", F.when(site.isNotNull(), "meta:og:site_name")).alias("brand_src"),
        F.coalesce("description", og_text).alias("description"),
        F.coalesce("description_src", F.when(og_text.isNotNull(), "meta:og:description")).alias("description_src"),
        F.coalesce("price", "dom_price").alias("price"),
        F.coalesce(F.when(~no_json, F.col("currency")), "dom_currency").alias("currency"),
        compare.alias("compare_at_price"),
        source.alias("price_src"),
        "meta_site_name",
    )
