from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import quality, taxonomy, variants
from shelfmark.plans.extract import ANSWERS, extract, report
from shelfmark.plans.samples import sample_pages, sample_taxonomy


@pytest.fixture(scope="module")
def results(spark):
    return {r.page_id: r for r in extract(sample_pages(spark), sample_taxonomy(spark), source_col="source").collect()}


def test_refusals_are_explicit_and_never_at_price_zero(results):
    assert results[6].product is None and results[6].refused == "price" and quality.NO_PRICE in results[6].warnings
    assert results[7].product is None and results[7].refused == "categorical" and results[7].confidence < 0.35
    assert all(r.product.price.price > 0 for r in results.values() if r.product)


def test_categories_are_valid_and_marked_as_lexical(results, spark):
    valid = {r.path for r in sample_taxonomy(spark).collect()}
    for r in results.values():
        assert r.product is None or (r.product.category.name in valid and quality.LEXICAL in r.warnings)


def test_a_delivery_charge_is_no_price(results):
    assert results[1].product.price.price == 89.0 and results[1].field_sources["price"] == "json:offers.price+dom:compare-at"


def test_no_combination_is_made_up(results):
    combos = {tuple(sorted(v.options.items())) for v in results[5].product.variants}
    assert ("Color", "Olive") in {p for c in combos for p in c} and (("Color", "Olive"), ("Length", "Long")) not in combos
    assert [(o.name, list(o["values"])) for o in results[5].product.options] == [("Color", ["Black", "Olive"]), ("Length", ["Short", "Long"])]
    assert list(results[3].product.colors) == ["Grey", "Navy"]


def test_supplied_answers_are_used_and_checked(spark):
    answers = spark.createDataFrame([(3, "apparel>hats > caps", ["Warm", "", "Soft"], ["Ignored"], [("Color", "Shade"), ("Size", "Any/Size")], [0])], ANSWERS)
    row = extract(sample_pages(spark).filter("page_id = 3"), sample_taxonomy(spark), answers).first()
    p = row.product
    assert p.category.name == "Apparel > Hats > Caps" and list(p.key_features) == ["Warm", "Soft"] and quality.LEXICAL not in row.warnings
    assert {o.name for o in p.options} == {"Shade", "Size"} and len(p.image_urls) == 1
    assert {k for v in p.variants for k in v.options} == {"Shade", "Size"}


def test_deterministic_mode_refuses_for_want_of_a_price_only(spark):
    rows = {r.page_id: r for r in extract(sample_pages(spark), sample_taxonomy(spark), mode="deterministic").collect()}
    assert rows[7].refused == rows[6].refused == "price"


def test_report_lines(spark):
    lines = {r.page_id: r.line for r in report(extract(sample_pages(spark), sample_taxonomy(spark), source_col="source")).collect()}
    assert "REFUSED" in lines[6] and lines[1].startswith("page-1.html") and "EUR   89.00" in lines[1]


def test_empty_input(spark):
    assert extract(sample_pages(spark).limit(0), sample_taxonomy(spark)).count() == 0


def test_a_branch_reaches_what_words_do_not(spark):
    paths = ["Apparel > Bottoms > Pants", "Apparel > Bottoms > Denim", "Apparel > Tops > Shirts", "Garden > Tools > Hoes"]
    tax = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord int")
    asked = spark.createDataFrame([(1, "blue denim trousers")], "query_id int, query string")
    listed = taxonomy.shortlist(asked, tax, k=1)
    assert [r.path for r in listed.collect()] == ["Apparel > Bottoms > Denim"]
    assert "Apparel > Bottoms > Pants" in [r.path for r in taxonomy.expand(listed, tax).collect()]


def test_guesses_and_fallbacks(spark):
    tax = sample_taxonomy(spark)
    asked = spark.createDataFrame([(1, "head lamps for camping"), (2, ""), (3, "zzz")], "query_id int, answer string")
    got = {r.query_id: (r.category, r.how) for r in taxonomy.coerce(asked, tax).collect()}
    assert got[1] == ("Outdoor > Lighting > Head Lamps", "guessed") and got[2][1] == "fallback" and got[3][0] == "Furniture > Chairs > Stools"


def test_confidence_of_a_bare_page(spark):
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    row = spark.range(1).select(quality.confidence(F.lit("N"), F.lit(None).cast("double"), empty, none, none, empty, F.lit(False), empty, F.array(F.lit(quality.UNRENDERED), F.lit(quality.NO_PRICE))).alias("c")).first()
    assert row.c == pytest.approx(0.30 * 0.4 * 0.85, abs=1e-3)


def test_selection(spark):
    v = spark.createDataFrame([([("a", {"Size": "S"}, "in_stock"), ("b", {"Size": "M"}, "out_of_stock")],)], "vs array<struct<sku: string, options: map<string, string>, availability: string>>")
    pick = lambda m: variants.match_variant(F.col("vs"), F.array(F.lit("Size")), m)["sku"]
    row = v.select(pick(F.create_map(F.lit("Size"), F.lit("M"))).alias("m"), pick(F.create_map().cast("map<string,string>")).alias("n"), variants.reachable(F.col("vs"), F.lit("Size"), F.create_map().cast("map<string,string>")).alias("r")).first()
    assert row.m == "b" and row.n is None and row.r == ["S"]
