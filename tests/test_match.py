from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import merchants as M
from shelfmark.operators import sketches as S
from shelfmark.operators import tokens as T


def _valid(number):
    full = number.zfill(14)
    return sum(int(d) * (3 if i % 2 == 0 else 1) for i, d in enumerate(full)) % 10 == 0 and int(full) > 0


def test_trade_item_numbers(spark):
    given = ["4006381333931", "0036000291452", "036000291452", "73513537", "96385074", "10036000291459", "4006381333932", "123", "", None, "00000000", "4006381-333931", " 4006381333931 ", "40063813339x1", "4006381333931-", "４００６３８１３３３９３１"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").select("i", M.gtin14(F.col("g")).alias("n")).collect()
    plain = {i: (g or "").strip().replace("-", "") if i != 14 else "no" for i, g in enumerate(given)}
    for r in rows:
        p = plain[r.i]
        assert r.n == (p.zfill(14) if p.isascii() and p.isdigit() and len(p) in M.LENGTHS and _valid(p) else None)


def test_articles_are_the_components_of_a_plain_comparison(spark):
    draw = random.Random(6)
    numbers = ["4006381333931", "04006381333931", "036000291452", "73513537", "4006381333939", None, ""]
    rows = [(i, draw.choice(numbers), draw.choice(["Acme", "ACME ", "Bolt", None, ""]), draw.choice(["x-1", "X1", "y2", None]), draw.choice(["Red Cap", "cap, red", "Cap", None, ""])) for i in range(60)] + [(None, numbers[0], "Acme", "x1", "Cap"), (3, numbers[2], None, None, None)]
    offers = spark.createDataFrame(rows, "offer_id long, gtin string, brand string, mpn string, name string")
    got = {r.offer_id: r.article for r in M.same_articles(offers).collect()}

    def keys(g, b, m, n):
        plain = "".join(c for c in (b or "").lower() if c.isalnum()), "".join(c for c in (m or "").lower() if c.isalnum())
        words = tuple(sorted(set((n or "").lower().replace(",", " ").split())))
        return ({("g", g.zfill(14))} if g and len(g) in M.LENGTHS and _valid(g) else set()) | ({("m", *plain, words)} if all(plain) and words else set())

    have = [(i, keys(*r)) for i, *r in rows if i is not None]
    root = {i: i for i, _ in have}
    for _ in range(60):
        for i, a in have:
            for j, b in have:
                if i == j or a & b:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root
    assert M.same_articles(offers.limit(0)).count() == 0


def test_a_wrong_number_joins_nothing(spark):
    # Planted: the same wrong number on two different articles, and one part number used for two.
    rows = [(1, "4006381333932", "A", "1", "Red cap"), (2, "4006381333932", "B", "2", "Blue hat"), (3, None, "A", "1", "Steel bolt"), (4, None, "a", "1", "cap red")]
    got = {r.offer_id: r.article for r in M.same_articles(spark.createDataFrame(rows, "offer_id long, gtin string, brand string, mpn string, name string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


@pytest.mark.parametrize(("together", "urls"), [(100_000, 200_000), (3, 5)])
def test_tokens_are_found_as_contains_would(spark, monkeypatch, together, urls):
    monkeypatch.setattr(T, "TOKENS_TOGETHER", together)
    monkeypatch.setattr(T, "URLS_TOGETHER", urls)
    pages = [(1, "http://a/12/ab"), (2, "http://b/2"), (2, "http://b/2"), (3, None), (4, ""), (5, "äß/12"), (None, "12")]
    words = ["1", "12", "2", "a", "äß", "", None, "12", "zz", "/"]
    got = T.tokens_in_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(w,) for w in words], "token string")).collect()
    want = [(i, w) for i, u in pages if i is not None and u for w in {w for w in words if w} if w in u]
    assert sorted(map(tuple, got)) == sorted(want)
    assert T.tokens_in_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "token string")).count() == 0


def test_merged_sketches_say_what_one_pass_says(spark):
    rows = spark.range(20_000).selectExpr("id % 7 AS day", "cast(id % 900 as string) AS k", "cast((id * 7919) % 10007 as double) AS amount", "cast(floor(sqrt(id % 50)) as int) AS v")
    merged = S.told(S.merged(S.summarised(rows, ["day"], "k", "amount", "v"), [])).first()
    whole = S.told(S.summarised(rows, [], "k", "amount", "v")).first()
    assert merged.n == whole.n == 20_000 and merged.top == whole.top and len(merged.top) == 5
    assert abs(merged.distinct - 900) <= S.DISTINCT_ERROR * 900
    for q, got in zip((0.25, 0.5, 0.75), merged.quantiles, strict=True):
        assert abs(rows.filter(F.col("amount") <= got).count() / 20_000 - q) <= S.RANK_ERROR


def test_bitmaps_count_any_selection(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice("abc"), draw.choice(["x", "y", None]), draw.randrange(3)) for i in range(70_000)]
    entries = S.numbered(spark.createDataFrame(rows, "id int, brand string, root string, band int"), "id")
    assert entries.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (70_000, 0, 69_999)
    bitmaps = S.facet_bitmaps(entries, ["brand", "root", "band"]).cache()
    asked = {"a": {"brand": "a"}, "ax": {"brand": "a", "root": "x"}, "by2": {"brand": "b", "root": "y", "band": "2"}, "none": {"brand": "q", "band": "1"}}
    got = {r.selection: r.n for r in S.selected(bitmaps, spark.createDataFrame([(s, f, v) for s, w in asked.items() for f, v in w.items()] * 2, "selection string, facet string, value string")).collect()}
    named = [dict(zip(("id", "brand", "root", "band"), map(str, r), strict=True)) for r in rows]
    assert got == {s: sum(all(r[f] == v for f, v in w.items()) for r in named) for s, w in asked.items()}


def test_only_keys_that_an_offer_has_both_of_are_linked(spark, monkeypatch):
    linked = []
    whole = M.connected_components
    monkeypatch.setattr(M, "connected_components", lambda edges: linked.append(edges.collect()) or whole(edges))
    number = "00012345678905"
    rows = [(i, number, "B", None, "x") for i in range(50)] + [(70, number, "B", "M1", "x"), (60, None, "B", "M1", "x"), (80, None, None, None, None)]
    got = M.same_articles(spark.createDataFrame(rows, "offer_id long, gtin string, brand string, mpn string, name string"))
    assert {r.offer_id: r.article for r in got.collect()} == {**{i: 0 for i in (*range(50), 60, 70)}, 80: 80}
    assert [tuple(r) for r in linked[0]] == [(0, 60)]
