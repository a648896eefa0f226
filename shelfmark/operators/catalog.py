"""Reading a finished catalog: filters, pages, facets, lookups, offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.money import effective_price
from shelfmark.functions.text import slug
from shelfmark.functions.urls import domain_of


def entry_id(brand: Column, name: Column, source: Column) -> Column:
    """The slug of brand and name, or of the source if that is empty; not necessarily unique."""
    return F.coalesce(F.nullif(slug(F.concat(F.coalesce(brand, F.lit("")), F.lit("-"), F.coalesce(name, F.lit("")))), F.lit("")), slug(source))


def matching(catalog: DataFrame, brand: str | None = None, category: str | None = None, exact_brand: bool = False) -> DataFrame:
    """Entries of a brand (any case, unless ``exact_brand``) under a category prefix."""
    found = catalog
    if brand:
        found = found.filter(F.col("brand") == brand) if exact_brand else found.filter(F.lower("brand") == brand.lower())
    return found.filter(F.col("category").startswith(category)) if category else found


def page_of(catalog: DataFrame, order: str = "ord", limit: int = 60, offset: int = 0, brand: str | None = None, category: str | None = None) -> DataFrame:
    """One page of the matching entries in catalog order."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return matching(catalog, brand, category).orderBy(order).offset(offset).limit(limit)


def total(catalog: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    return matching(catalog, brand, category).agg(F.count("*").alias("total"))


def facets(catalog: DataFrame) -> DataFrame:
    """``facet``, ``value``: distinct brands (not empty) and categories of the whole catalog."""
    brands = catalog.filter("brand <> ''").select(F.lit("brand").alias("facet"), F.col("brand").alias("value")).distinct()
    return brands.unionByName(catalog.filter("category is not null").select(F.lit("category").alias("facet"), F.col("category").alias("value")).distinct())


def facet_counts(catalog: DataFrame) -> DataFrame:
    """Entries per brand, per category and in all, in one pass over grouping sets."""
    return catalog.sparkSession.sql("SELECT brand, category, count(*) AS n FROM {catalog} GROUP BY GROUPING SETS ((brand), (category), ())", catalog=catalog)


def health(catalog: DataFrame) -> DataFrame:
    """One row: ``status`` and how many ``products`` the catalog has; an empty one is ok with none."""
    return catalog.agg(F.lit("ok").alias("status"), F.count("*").alias("products"))


def root_facet(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.trim(F.split_part("category", F.lit(">"), F.lit(1))).alias("root")).filter("root <> ''").distinct()


def lookup(catalog: DataFrame, wanted: str, order: str = "ord") -> DataFrame:
    """The first entry with that id, or no row."""
    return catalog.filter(F.col("id") == wanted).orderBy(order).limit(1)


def offers(entries: DataFrame) -> DataFrame:
    """One offer per entry with a URL; the selected variant's price, state and number go first.

    Expects ``url``, ``price`` (struct), ``variants`` and ``selected`` (struct or null).
    """
    rows = entries.filter(F.coalesce("url", F.lit("")) != "")
    sku = F.coalesce("selected.sku", F.try_element_at("variants", F.lit(1))["sku"])
    return rows.withColumns({"offer_price": effective_price(F.col("price"), F.col("selected.price")), "domain": domain_of(F.col("url")), "availability": F.coalesce("selected.availability", F.lit("unknown")), "sku": sku})


def buyable(availability: Column) -> Column:
    return ~availability.isin("out_of_stock", "discontinued")


def ordered_offers(rows: DataFrame, key: str, price: str, availability: str, tie: str) -> DataFrame:
    """Offers with ``place`` (buyable first, then by price) and ``is_lead``: the cheapest that can be bought, else the cheapest."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.when(buyable(F.col(availability)), 0).otherwise(1), price, tie)
    return rows.withColumn("place", F.row_number().over(order)).withColumn("is_lead", (F.col("place") == 1) & (F.count("*").over(Window.partitionBy(key)) > 1))


def gallery(variant_images: Column, product_images: Column) -> Column:
    """A variant's images, then the product's that are not among them."""
    none = F.array().cast("array<string>")
    first = F.coalesce(variant_images, none)
    return F.concat(first, F.filter(F.coalesce(product_images, none), lambda u: ~F.array_contains(first, u)))


def spec_rows(entries: DataFrame, key: str = "id") -> DataFrame:
    """``key``, ``place``, ``label``, ``value``: brand, category, chosen axes or colours, numbers; blanks left out.

    Expects ``brand``, ``category``, ``colors``, ``selected`` and ``variants``.
    """
    who = F.coalesce("selected", F.when(F.size("variants") == 1, F.try_element_at("variants", F.lit(1))))

    def row(label: Column | str, value: Column) -> Column:
        return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), F.trim(value).alias("value"))

    colors = F.when(F.col("selected").isNull() & (F.size("colors") > 0), F.array_join("colors", ", "))
    axes = F.coalesce(F.transform(F.map_entries("selected.options"), lambda e: row(e["key"], e["value"])), F.array().cast("array<struct<label: string, value: string>>"))
    listed = F.concat(
        F.array(row("Brand", F.col("brand")), row("Category", F.col("category"))), axes,
        F.array(row(F.when(F.size("colors") > 1, "Colors").otherwise("Color"), colors), row("SKU", who["sku"]), row("GTIN", who["gtin"]), row("MPN", who["mpn"])),
    )
    return entries.select(key, F.posexplode(F.filter(listed, lambda r: F.coalesce(r["value"], F.lit("")) != "")).alias("place", "r")).select(key, "place", "r.label", "r.value")


def provenance(entries: DataFrame, key: str = "id") -> DataFrame:
    """``key``, ``percent`` of confidence, ``field``, ``source`` pairs."""
    return entries.select(key, F.floor(F.col("confidence") * 100 + 0.5).cast("int").alias("percent"), F.explode("field_sources").alias("field", "source"))


def selection_hint(options: Column, selection: Column, n_variants: Column) -> Column:
    """What is still to be selected, or how many configurations there are."""
    missing = F.transform(F.filter(options, lambda o: ~F.map_contains_key(selection, o["name"])), lambda o: F.lower(o["name"]))
    asked = F.concat(F.lit("Select "), F.array_join(missing, " and "), F.lit(" — "), n_variants.cast("string"), F.lit(" configurations available"))
    return F.when(F.size(missing) > 0, asked).otherwise(F.concat(F.lit("1 of "), n_variants.cast("string"), F.lit(" configurations")))


def swatches(colors: Column, names: Column, most: int = 5) -> Column:
    """The first colours, null unless one of them is a known colour name."""
    from shelfmark.functions.choices import swatch_color

    first = F.slice(colors, 1, most)
    return F.when(F.exists(first, lambda c: swatch_color(c, names).isNotNull()), first)


def as_chips(n_values: Column) -> Column:
    """Whether a facet is small enough to be shown as chips."""
    return n_values <= 8
