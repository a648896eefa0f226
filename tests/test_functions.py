from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import choices as C
from shelfmark.functions import money as M
from shelfmark.functions import text as T
from shelfmark.functions import urls as U


def run(spark, build, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_of_every_convention(spark):
    cases = {
        "1.234": 1234.0, "1,234": 1234.0, "349,00": 349.0, "1.234.567": 1234567.0, "1,234.56": 1234.56, "1.234,56": 1234.56, "10.24": 10.24, "1 234,50": 1234.5,
        " 12 ": 12.0, "1 299,00": 1299.0, "12.": 12.0, "abc": None, "": None, None: None, "1,2,3.4.5": None, "-5": -5.0, "0": 0.0,
    }
    assert run(spark, M.parse_localized, list(cases)) == list(cases.values())
    assert run(spark, M.amount_of, ["0", "-3", "10000001", "10000000"]) == [None, None, None, 1e7]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(1, 99_999_999), min_size=40, max_size=40))
def test_written_amounts_are_read_back(spark, cents):
    amounts = [c / 100 for c in cents]
    for group, mark in ((",", "."), (".", ","), (" ", ","), ("", "."), ("", ",")):
        texts = [f"{a:,.2f}".replace(",", "_").replace(".", mark).replace("_", group) for a in amounts]
        assert run(spark, M.amount_of, texts) == amounts


def test_rows_of_signs_are_no_currency(spark):
    found = run(spark, M.money_mentions, ["+1 (678) 555-5272$$$ on$$$ 37 %%%", "10.1.2.3$$$", "US$$ 5 and 6 €€", "a$$$ $7", "8€ 9$"])
    assert [[(m.amount, m.currency) for m in x] for x in found] == [[], [], [], [(7.0, "USD")], [(8.0, "EUR"), (9.0, "USD")]]


def test_money_on_either_side(spark):
    found = run(spark, M.money_mentions, ["C$ 12.50 or 1.299,00 €", "kr 99", "SEK 1 200", "＄5", "no money 5", "zł 10 US$7"])
    assert [[(m.amount, m.currency) for m in r] for r in found] == [[(12.5, "CAD"), (1299.0, "EUR")], [], [(1200.0, "SEK")], [(5.0, "USD")], [], [(10.0, "PLN"), (7.0, "USD")]]


def test_sentinels_and_cleaning(spark):
    assert run(spark, T.clean_text, ["Loading...", " n/a ", "--", "…", " ", "<b>Kit</b>&nbsp;(A &amp; B)", "tbd tbd", "None of it", None, "loading…"]) == [None, None, None, None, None, "Kit (A & B)", None, "None of it", None, None]
    assert run(spark, T.drop_title_suffix, ["Chair | Shop", "A – B – Shop", "Plain"]) == ["Chair", "A – B", "Plain"]
    assert run(spark, T.slug, ["Brand-Été 50% off!", "--", "a" * 90]) == ["brand-été-50-off", "", "a" * 60]
    assert run(spark, T.first_sentence, ["One. Two.", "No end", "v1.2 is out! Yes"]) == ["One.", "No end", "v1.2 is out!"]


def test_image_urls(spark):
    urls = ["https://c.x/img/a.jpg", "data:image/png;base64,AAAA", "//cdn.x/a", "ftp://x/a.jpg", "https://x/page", "short", None]
    assert run(spark, U.is_image_url, urls) == [True, False, True, False, False, False, None]
    assert run(spark, U.dimensions, ["x?w=100&h=2", "x/800x600/y", "a-1200x900.jpg", "none"]) == [100, 800, 1200, 0]
    assert run(spark, U.identity_key, ["https://x/a-large.jpg?w=1", "https://x/a_800x600.jpg", "https://x/t/123e4567-e89b-12d3-a456-426614174000/f.png"]) == ["https://x/a.jpg", "https://x/a.jpg", "123e4567-e89b-12d3-a456-426614174000/f.png"]
    assert run(spark, U.asset_boundary, ["media[0].sources.max[0]", "a.b[2].url", "a.b", "images[1]", "gallery[3].detail"]) == ["media[0]", "a.b[2]", None, None, None]
    assert run(spark, lambda v: U.absolute(v, F.lit("https://s.x/a/b")), ["/i.jpg", "i.jpg", "//c.x/i.jpg", "http://o/i"]) == ["https://s.x/i.jpg", "https://s.x/a/i.jpg", "https://c.x/i.jpg", "http://o/i"]
    assert run(spark, U.split_srcset, ["a.jpg 1x, b.jpg 2x", "https://x/a,b.jpg"]) == [["a.jpg", "b.jpg"], ["https://x/a,b.jpg"]]


def test_axes_and_stock(spark):
    assert run(spark, C.axis_of_key, ["color", "sizeId", "Widths", "Sizes", "count", "colour_id", None]) == ["Color", "Size", "Width", None, None, "Color", None]
    assert run(spark, lambda v: C.stock_of(F.lit("str"), v, F.lit(None).cast("double")), ["InStock", "backorder", "Sold out", "pre-sale", "maybe"]) == ["in_stock", "in_stock", "out_of_stock", "preorder", None]


@pytest.mark.parametrize(("price", "was", "percent"), [(50.0, 100.0, 50), (99.5, 100.0, 1), (100.0, 100.0, None), (5.0, None, None), (2.0, 3.0, 33)])
def test_discount(spark, price, was, percent):
    row = spark.createDataFrame([(price, was)], "p double, w double").select(M.discount_percent(F.col("p"), F.col("w")).alias("x")).first()
    assert row.x == percent


def test_trimming_knows_the_white_space_of_the_pattern(spark):
    from shelfmark.functions import patterns as P

    every = [chr(c) for c in range(0x3100) if re.fullmatch(f"[{P.WS}]", chr(c))]
    assert sorted(every) == sorted(P.SPACES)
    texts = [f"{c}a{c} b{c}{c}" for c in every] + ["\u200ba\u200b", "", " ", None]
    assert run(spark, T.strip, texts) == [f"a{c} b" for c in every] + ["\u200ba\u200b", "", "", None]
    assert run(spark, T.collapse, texts) == ["a b"] * len(every) + ["\u200ba\u200b", "", "", None]
