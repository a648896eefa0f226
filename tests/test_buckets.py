from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import fields, graph, taxonomy, variants
from shelfmark.plans.samples import sample_pages
from shelfmark.plans.shopfront import ShopRun, shop_pages, shop_run
from shelfmark.sources import harvest, stages
from shelfmark.sources.pages import parse_page, parsed_pages

SF = "/root/testdata/sf0.001"


def _shuffles(df) -> int:
    with stages._settings(df.sparkSession, stages.IN_PLACE):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return sum(line.lstrip(" :+-*(0123456789)").startswith("Exchange ") for line in lines)


@pytest.fixture(scope="module")
def run(spark):
    return shop_run(spark, SF)


def test_a_small_file_of_pages_is_many_tasks(spark, tmp_path):
    sample_pages(spark).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    parsed = parsed_pages(pages, buckets=5)
    assert parsed.rdd.getNumPartitions() == 5 and parsed.count() == pages.count()


def test_pages_and_line_items_are_shuffled_once(spark):
    assert _shuffles(shop_pages(spark, SF)) == 2  # line items and parts, and no more for their groups and pages


def test_what_is_told_of_a_page_stays_in_its_bucket(run):
    dom, nodes, products = run["elements"], run["objects"], run["products"]
    assert _shuffles(fields.dom_price(dom)) == 0
    assert _shuffles(fields.brands(products, nodes)) == 0
    assert _shuffles(graph.graph_breadcrumbs(nodes)) == 0
    assert _shuffles(variants.axis_definitions(nodes)) == 0


def test_a_bucket_is_one_file_and_its_rows_are_all_there(spark):
    with stages.scratch_scope(spark):
        made = stages.bucketed(spark.range(1000).select((F.col("id") % 100).alias("page_id"), "id"), "b", 4)
        folder = os.path.dirname(made.inputFiles()[0].removeprefix("file://"))
        assert len(made.inputFiles()) == 4 and made.distinct().count() == 1000
        assert made.groupBy("page_id").count().filter("count = 10").count() == 100
    assert not os.path.exists(folder)


def test_session_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in stages.IN_PLACE}
    with pytest.raises(Exception, match="no such"):
        stages.bucketed(spark.range(3).select(F.col("id").alias("page_id"), F.raise_error(F.lit("no such")).alias("x")), "b", 2)
    assert {k: spark.conf.get(k, None) for k in stages.IN_PLACE} == before


def test_bucket_count(spark):
    cores = spark.sparkContext.defaultParallelism
    assert stages.bucket_count(spark, 0) == 1 and stages.bucket_count(spark, 200) == 1
    assert stages.bucket_count(spark, 2500) == min(2 * cores, 10) and stages.bucket_count(spark, 1_200_000) == 300


def test_members_by_name_in_any_case(spark):
    kv = "array<struct<k: string, kind: string, s: string>>"
    row = spark.createDataFrame([([("SKU", "str", "a"), ("sku", "str", "b"), ("x", "str", "c")],), (None,)], f"kv {kv}")
    got = [r.v for r in row.select(F.transform(graph.members(("sku", "no")), lambda r: r["m"]["s"]).alias("v")).collect()]
    assert got == [["b", None], [None, None]]
    assert [r.v for r in row.select(graph.first_said(("sku",), lambda m: m["s"], any_case=True).alias("v")).collect()] == ["a", None]


def test_a_join_by_page_and_number_sorts_no_objects(run):
    nodes, dom = run["objects"], run["elements"]
    for joined in (nodes.join(nodes.select("page_id", "n", F.col("path").alias("at")), ["page_id", "n"]), dom.join(dom.select("page_id", "nid", F.col("tag").alias("t")), ["page_id", "nid"])):
        with stages._settings(joined.sparkSession, stages.IN_PLACE):
            lines = joined._jdf.queryExecution().executedPlan().toString().split("\n")
        assert not [line for line in lines if line.lstrip(" :+-*(0123456789)").startswith("Sort ")]
    assert "score" in nodes.columns


def test_members_that_are_there(spark):
    kv = "array<struct<k: string, kind: string, s: string>>"
    row = spark.createDataFrame([([("b", "str", "2"), ("x", "str", "9"), ("a", "str", "1")],), ([("A", "str", "4"), ("a", "str", "5")],), ([],), (None,)], f"kv {kv}")

    def read(any_case):
        listed = F.transform(graph.present(("a", "b", "c"), any_case=any_case), lambda r: F.concat_ws(":", r["key_ord"].cast("string"), r["k"], r["m"]["s"]))
        return [r.v for r in row.select(listed.alias("v")).collect()]

    assert read(False) == [["0:a:1", "1:b:2"], ["0:a:5"], [], None]
    assert read(True) == [["0:a:1", "1:b:2"], ["0:a:4"], [], None]


def test_an_object_is_held_under_the_name_that_its_holder_gives(run):
    nodes = run["objects"]
    said = nodes.select("page_id", F.inline("kv")).select("page_id", "k", F.explode(F.concat(F.array("child"), F.coalesce(F.transform("items", lambda x: x["child"]), F.array()))).alias("n")).filter("n is not null")
    found = said.join(nodes.select("page_id", "n", "parent_key", "path"), ["page_id", "n"])
    assert found.count() == said.count() > 0 and found.filter("k <> parent_key").count() == 0
    assert found.filter("k = 'variants'").filter(~F.col("path").endswith("]")).count() == 0


def test_parts_of_a_page_are_those_of_the_whole(spark):
    pages = [r.html for r in sample_pages(spark).collect()] + ['<script type="application/json">[["a"],{"x":["b"]},["c"]]</script>', "", None]
    for page in pages:
        whole = parse_page(page)
        for part in ("html", "body_text", "dom", "objects", "strings"):
            some = parse_page(page, (part,))
            assert some[part] == whole[part] and all(v is None for k, v in some.items() if k != part)


def test_objects_without_their_places_are_those_of_the_walk():
    deep = {"a": [{"id": 1}, [[{"id": 2}], "s"], {"b": {"c": [1, {"id": 3}]}}], "z": {}}
    for _ in range(20):
        deep = {"x": [deep, {"y": deep}] if _ < 3 else deep}
    for blob in (deep, [deep, "s"], [[]], {}):
        assert [id(o) for o in harvest.objects_of(blob)] == [id(p.value) for p in harvest.walk(blob) if isinstance(p.value, dict)]


def test_elements_and_objects_wait_for_no_more_than_they_are_read_for(spark):
    with stages.scratch_scope(spark):
        run = ShopRun(spark, SF)
        assert run["elements"].count() > 0 and run["objects"].count() > 0
        assert set(run.made) == {"pages", "elements", "objects"}
        assert "dom" not in run["parsed"].columns or run["parsed"].filter("dom is not null or objects is not null").isEmpty()


def test_what_a_step_wrote_on_the_way_is_removed(spark):
    with stages.scratch_scope(spark) as outer:
        written = []

        def make():
            written.append(stages.bucketed(spark.range(100).select(F.col("id").alias("page_id")), "way", 2))
            return written[0].select("page_id", (F.col("page_id") * 2).alias("x"))

        made = stages.settled(spark, make, "made", 2)
        assert len(outer) == 1 and made.agg(F.sum("x")).first()[0] == 9900
        folder = os.path.dirname(os.path.dirname(made.inputFiles()[0].removeprefix("file://")))
        assert not [f for f in os.listdir(folder) if f.startswith("way-")]


def test_one_pass_gives_the_tables_that_are_read_each_by_itself(spark):
    with stages.scratch_scope(spark):
        alone, whole = ShopRun(spark, SF), ShopRun(spark, SF)
        whole.read_at_once()
        assert set(whole.made) == {"pages", "elements", "objects", "parsed"}
        for step, number in (("elements", "nid"), ("objects", "n"), ("parsed", "page_id")):
            wanted = [c for c in alone[step].columns if c in whole[step].columns]
            assert set(alone[step].columns) - set(wanted) <= {"dom", "objects"}
            rows = [[str(r) for r in t.select(*wanted).orderBy("page_id", number).collect()] for t in (alone[step], whole[step])]
            assert rows[0] == rows[1] and rows[0]
        # Rows of a page stay in its bucket and in their order, so that a join by them shuffles and sorts nothing.
        with stages._settings(spark, stages.IN_PLACE):
            plan = whole["objects"].select("page_id", "n", "path").join(alone["objects"].select("page_id", "n", "score"), ["page_id", "n"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan


def test_terms_are_counted_once_for_their_weights_and_lengths(spark):
    weights = spark.createDataFrame([("bolt", 0.5)], "term string, idf double")
    docs = spark.createDataFrame([(1, "bolt nut"), (2, "")], "id long, text string")
    found = taxonomy.vectors(docs, "id", "text", weights, spark.range(1).select(F.lit(2.0).alias("unseen")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert abs(found.agg(F.sum(F.col("w") * F.col("w"))).first()[0] - 1) < 1e-9
