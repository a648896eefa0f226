from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.operators import dom as D
from shelfmark.plans.samples import MICRODATA, PAGES, sample_pages
from shelfmark.plans.shopfront import shop_run
from shelfmark.sources import harvest as H
from shelfmark.sources import literals as L
from shelfmark.sources import stages
from shelfmark.sources.catalog import read_catalog, read_taxonomy, write_results
from shelfmark.sources.pages import decode, dom_nodes, json_nodes, parse_page, parsed_pages, read_files
from shelfmark.sources.tree import deep_text, parse

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=12), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=6), JSON, max_size=5))
def test_brackets_and_js_reader_agree_with_json(value):
    text = json.dumps(value)
    assert L.balanced("x = " + text + "; y = {}", 4) == text
    assert L.loads_js(text) == value


def test_js_literals():
    assert L.loads_js("{a: 1, 'b': [1,,2], c: f(x, {y: 1}), d: .5, e: 0x1F, /* n */ f: undefined, // x\n g: `t`, h: -3e2,}") == {"a": 1, "b": [1, 2], "d": 0.5, "e": 31, "f": None, "g": "t", "h": -300.0}
    assert L.loads_js("[a, 1]") == [None, 1] and L.loads_js("{a 1}") is None and L.loads_js("nope") is None
    assert L.balanced('{"a": "}', 0) is None and L.balanced('{"a": "}"}x', 0) == '{"a": "}"}'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["ref", "itemId", "media", "x"]), st.integers(0, 6)), max_size=12))
def test_references_in_circles_end(edges):
    rows = [{"id": f"n{i}x", **{k: f"n{t}x" for s, k, t in edges if s == i}} for i in range(7)]
    graph = H.followed([("x", rows)])
    assert len(json.dumps(graph)) < 5_000_000
    assert sum(1 for _ in H.walk(graph[0])) >= 7


def test_a_reference_is_replaced_by_its_row():
    assert H.followed([("x", [{"id": "p:1", "name": "N", "mediaId": "m:1"}, {"id": "m:1", "url": "u"}, {"__ref": "p:1"}])])[0][2]["mediaId"] == {"id": "m:1", "url": "u"}


def test_tree_repairs_common_omissions():
    nodes = parse("<ul><li>a<li>b</ul><p>c<p>d<div>e</div><table><tr><td>f<td>g<tr><td>h</table></p></x>i")
    tags = [(n.tag, "".join(n.texts)) for n in nodes[1:]]
    assert tags == [("ul", ""), ("li", "a"), ("li", "b"), ("p", "c"), ("p", "d"), ("div", "e"), ("table", ""), ("tr", ""), ("td", "f"), ("td", "g"), ("tr", ""), ("td", "h")]
    assert deep_text(nodes[0]) == "abcdefghi"
    for n in nodes[1:]:
        assert n.parent.nid < n.nid <= n.parent.last


def test_lower_casing_a_page_loses_no_carrier():
    for page in (MICRODATA, PAGES[1], PAGES[5]):
        shouted = page.replace("itemprop", "itemProp").replace("itemscope", "itemScope").replace("<script", "<SCRIPT").replace("</script", "</SCRIPT")
        assert sorted(o["carrier"] for o in parse_page(page)["objects"]) == sorted(o["carrier"] for o in parse_page(shouted)["objects"])


def test_microdata_as_a_join_is_what_the_walk_finds(spark):
    parsed = parsed_pages(sample_pages(spark).filter("page_id = 4")).cache()
    joined = {(r.scope_type, r.name, r.value) for r in D.annotations(dom_nodes(parsed)).collect() if r.value is not None}
    walked = set()
    for o in json_nodes(parsed).collect():
        kind = next(m.s for m in o.kv if m.k == "@type")
        walked |= {(kind, m.k, m.s) for m in o.kv if m.kind == "str" and not m.k.startswith("@")}
    assert joined == walked


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<" * 500), (4, "<p>" * 3000), (5, "<script>{\"a\":" + "[" * 400 + "</script>"), (6, "\u0000<b>x")], "page_id long, html string")
    assert parsed_pages(pages).count() == 6


def test_decoding_is_strict(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b'<meta charset="iso-8859-1"><p>caf\xe9</p>')
    (tmp_path / "b.html").write_bytes("﻿<p>café</p>".encode())
    (tmp_path / "c.html").write_bytes(b'<meta charset="no-such"><p>\xff\xfe</p>')
    got = {r.source: r for r in decode(read_files(spark, str(tmp_path))).collect()}
    assert "café" in got["a.html"].html and got["b.html"].html == "<p>café</p>"
    assert got["c.html"].html is None and got["c.html"].error == "could not decode document; tried no-such: LookupError, utf-8: UnicodeDecodeError"


def test_taxonomy_and_catalog_files(spark, tmp_path):
    (tmp_path / "tax.txt").write_text("# note\nA > B\n\n A > C \r\nD\n")
    assert [(r.path, r.ord) for r in read_taxonomy(spark, str(tmp_path / "tax.txt")).collect()] == [("A > B", 1), ("A > C", 3), ("D", 4)]
    assert read_catalog(spark, str(tmp_path / "none")).count() == 0
    product = {"name": "N", "brand": "B", "price": {"price": 1.5, "currency": "EUR"}, "category": {"name": "A > B"}}
    (tmp_path / "products.json").write_text(json.dumps([{"product": product, "url": "u", "source": "s", "confidence": 0.9}, {"source": "t", "error": "x"}]))
    rows = read_catalog(spark, str(tmp_path / "products.json"))
    assert [(r.id, r.category, r.product.price.price) for r in rows.collect()] == [("b-n", "A > B", 1.5)]
    where = write_results(rows.drop("id", "brand", "category"), str(tmp_path / "out"))
    assert where.endswith("products.deterministic") and read_catalog(spark, where).count() == 1


def test_stage_tables_go_with_their_scope(spark):
    from pathlib import Path

    from shelfmark.sources.stages import scratch_scope, shared_folder, staged

    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with scratch_scope(spark):
        assert staged(spark.range(5), "kept-inside").count() == 5
        assert len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before


def test_two_hundred_scripts_keep_their_order(spark):
    from shelfmark.operators import images
    from shelfmark.plans.samples import framework_pages
    from shelfmark.sources.pages import json_strings

    parsed = parsed_pages(framework_pages(spark).filter("page_id = 28"))
    dom, nodes = dom_nodes(parsed), json_nodes(parsed)
    found = images.candidates(dom, nodes, json_strings(parsed), images.identities(parsed, dom, nodes)).orderBy("ord").collect()
    assert [r.url.rsplit("-", 1)[1] for r in found] == [f"{i}.jpg" for i in range(200)]


def test_element_text_is_collapsed_before_it_is_cut():
    from shelfmark.sources.tree import collapsed_text, parse

    page = "<div>" + " \n" * 9000 + "<p>a  b</p>" + " " * 9000 + "c</div><h1>" + "word " * 3000 + "end</h1>"
    by_tag = {n.tag: n for n in parse(page)}
    assert collapsed_text(by_tag["div"], 500) == "a b c"
    assert collapsed_text(by_tag["div"], 2) == "a "
    assert collapsed_text(by_tag["h1"]).endswith("word end")


def test_headings_keep_their_whole_text(spark):
    from shelfmark.sources.pages import parsed_pages

    long = "word " * 2000 + "end"
    pages = spark.createDataFrame([(1, f"<title>{long}</title><h1>{long}</h1><p>{long}</p>"), (2, None), (3, "")], "page_id long, html string")
    dom = {(r.page_id, n.tag): n.text for r in parsed_pages(pages).collect() for n in r.dom}
    assert dom[1, "title"] == dom[1, "h1"] == long
    assert dom[1, "p"] == long[:500]


HALVES = r"""<script>var data = {"k\ud83d":["\udc00",{"name":"Stool \ud83d","a":"\ud83d\ude00","b":"\\ud83d"}]};</script><div data-x='{"title":"Attribute \ud83d"}'></div>"""


def test_halves_of_surrogate_pairs_harm_no_page(spark):
    pages = spark.createDataFrame([(1, HALVES), (2, PAGES[1]), (3, r"<script>x.y = {n:'js \ud83d', m:1}</script>")], "page_id long, html string")
    nodes = json_nodes(parsed_pages(pages)).collect()
    said = {(r.page_id, m.k): m.s for r in nodes for m in r.kv if m.kind == "str"}
    assert said[1, "name"] == "Stool \ufffd" and said[1, "title"] == "Attribute \ufffd" and said[1, "a"] == "\U0001f600" and said[1, "b"] == "\\ud83d"
    assert {r.parent_key for r in nodes if r.page_id == 1} == {None, "k\ufffd"} and {r.path for r in nodes if r.page_id == 1} == {"", "k\ufffd[1]"}
    assert said[3, "n"] == "js ud83d" and said[2, "sku"] == "4471"
    strings = [x for r in parsed_pages(pages).collect() for x in r.strings if r.page_id == 1]
    assert [(x.path, x.s) for x in strings] == [("k\ufffd[0]", "\ufffd")]


def test_what_cannot_be_read_costs_no_more_than_itself(spark):
    long = "9" * 5000
    assert L.loads_js(f"{{a:{{b:{long},c:1}},d:0x{'f' * 6000},e:[{long}]}}") == {"a": {"c": 1}, "e": [None]}
    assert L.loads_js('{product:{name:"X"},h:{onClick(){return 1}},z:2}') == {"product": {"name": "X"}, "z": 2}
    assert L.loads_js('{o:{...rest,b:1},l:[{get x(){return {a:1}}},3,{s}],product:{name:"X"}}') == {"l": [None, 3, None], "product": {"name": "X"}}
    assert L.loads_js("{a:,b:2,c:}") == {"b": 2} and L.loads_js("{f(){}}") is None and L.loads_js('{a:{["k"]:1},b:{c:1') is None
    pages = [(1, f"<script>window.__D = {{a:{{b:{long},name:'N'}}}}</script>"), (2, "<![foo[x]]><p>after"), (3, '<base><div itemscope><a itemprop=u href="http://[">t</a><b itemprop=v>w</b></div>' + '<link rel=canonical href="http://x/">'), (4, "<div itemscope>" * 3000)]
    parsed = {r.page_id: r for r in parsed_pages(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert [m.s for o in parsed[1].objects for m in o.kv if m.k == "name"] == ["N"]
    assert [n.tag for n in parsed[2].dom] == ["p"] and [m.s for o in parsed[3].objects for m in o.kv] == ["http://[", "w"]


def test_bytes_that_are_no_text_are_replaced(spark):
    rows = spark.createDataFrame([(1, bytearray(b"<title>caf\xe9</title>")), (2, bytearray(b"<title>b</title>"))], "page_id long, html binary")
    assert {r.page_id: r.dom[0].text for r in parsed_pages(rows).collect()} == {1: "caf\ufffd", 2: "b"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<![x[", "<!--", "-->", "<div itemscope itemprop=a>", "</div>", "<script>", "</script>", 'x.y={a:{b(){}},c:"', "'}", r'{"a":"\ud83d"}', "<a itemprop=b href='//['>", "&#xD800;", "<", "]]>", "\x00", "é"]), max_size=20))
def test_any_page_is_read(parts):
    found = parse_page("".join(parts))
    json.dumps(found, ensure_ascii=False).encode()
    for o in found["objects"]:
        assert o["n"] <= o["last"] and (o["parent"] is None or o["parent"] < o["n"] <= found["objects"][o["parent"]]["last"])


def test_evidence_is_short_and_without_empty_values():
    node = {"name": "N", "sku": "s", "price": 0, "brand": {}, "tracking": "no", "image": ["", {"a": None}, "i" * 900], "deep": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}, "x": False}, "list": list(range(20))}
    assert json.loads(H.evidence(node)) == {"name": "N", "sku": "s", "price": 0, "image": ["i" * 600], "deep": {"x": False}, "list": list(range(8))}
    assert H.evidence({"brand": "", "offers": [], "session": 1}) is None


def test_a_store_of_rows_that_all_name_each_other_is_followed_in_bounds():
    rows = [{"id": f"row-{i}", "others": [{"__ref": f"row-{j}"} for j in range(120)]} for i in range(120)]
    whole = H.followed([("x", rows)])
    assert all(o["id"] == f"row-{i}" for row in whole[0] for i, o in enumerate(row["others"]))
    refs = sum("__ref" in o for row in whole[0] for r in row["others"] for o in r["others"])
    assert 0 < refs and 120**3 - refs <= H.MOST_FOLLOWED


def test_threads_keep_their_own_stage_tables(spark):
    import threading

    from shelfmark.sources.stages import scratch_scope, staged

    made, go, done = {}, threading.Event(), threading.Event()

    def other():
        with scratch_scope(spark):
            made["other"] = staged(spark.range(3), "other")
            go.set()
            done.wait(60)
            made["count"] = made["other"].count()

    thread = threading.Thread(target=other)
    with scratch_scope(spark):
        thread.start()
        go.wait(60)
        own = staged(spark.range(4), "own")
    done.set()
    thread.join()
    assert made["count"] == 3  # closing the scope of this thread took nothing from the other one
    assert own.schema.names == ["id"]


def test_pages_of_many_objects_are_not_compared_each_with_each(spark):
    from shelfmark.operators import fields, graph

    offers = ",".join('{"@type":"Offer","price":"%d.50","priceCurrency":"EUR"}' % (i + 1) for i in range(9))
    products = ",".join(f'{{"@type":"Product","name":"N{i}","sku":"s{i}","offers":[{offers}]}}' for i in range(500))
    nodes = json_nodes(parsed_pages(spark.createDataFrame([(1, f'<script type="application/json">{{"all":[{products}]}}</script>')], "page_id long, html string"))).cache()
    assert nodes.count() == 5001
    held = fields.held_by(graph.product_nodes(nodes), nodes)
    assert held.count() == 5000 and fields.node_prices(graph.product_nodes(nodes), nodes).count() == 4500
    assert "stretch" in held._jdf.queryExecution().optimizedPlan().toString()


def test_table_functions_give_the_rows_of_the_tables(spark):
    import pytest

    from shelfmark.sources.sql import register

    register(spark)
    pages = sample_pages(spark).unionByName(spark.createDataFrame([(90, "n", None), (91, "e", "")], "page_id long, source string, html string"))
    pages.createOrReplaceTempView("udtf_pages")
    parsed = parsed_pages(pages).cache()
    got = spark.sql("SELECT p.page_id, e.nid, e.parent, e.last, e.depth, e.tag, e.text, e.class FROM udtf_pages p, LATERAL parse_html(p.html, 'class') e").collect()
    want = dom_nodes(parsed).selectExpr("page_id", "nid", "parent", "last", "depth", "tag", "text", "try_element_at(attrs, 'class')").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    got = spark.sql("SELECT p.page_id, h.n, h.path, h.ord, h.k, h.kind, h.value, h.child FROM udtf_pages p, LATERAL harvest_blobs(p.html) h").collect()
    want = json_nodes(parsed).selectExpr("page_id", "n", "path", "posexplode(kv) AS (i, m)").selectExpr("page_id", "n", "path", "i", "m.k", "m.kind", "m.s", "m.child").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    only = spark.sql("SELECT DISTINCT carrier FROM udtf_pages p, LATERAL harvest_blobs(p.html, 'microdata') h").collect()
    assert [r.carrier for r in only] == ["microdata"]
    with pytest.raises(Exception, match="parse_html reads a string"):
        spark.sql("SELECT * FROM parse_html(1)")


def test_pages_of_a_shop_are_read_no_further_than_asked(spark):
    with stages.scratch_scope(spark):
        shop_run(spark, "/root/testdata/sf0.001/")["pages"]
        assert [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in stages._OPEN.get()[-1]] == ["shop-pages"]
