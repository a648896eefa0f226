"""Variants and their axes, from lists of rows and from question-and-answer tables.

Nothing here makes up a combination: axes become variants only through rows or articles (SKUs) that
the page ties to a value on every axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions import urls as U
from shelfmark.functions.binding import let
from shelfmark.functions.choices import axis_of_key, axis_title, is_axis_id_key, is_null_choice, stock_of
from shelfmark.functions.money import amount_of_value, currency_of
from shelfmark.operators.graph import first_said, held_as, inside, member, present, scalar_of, string_of
from shelfmark.sources.stages import kept, reused

OPTION = "array<struct<prio: int, ord: int, axis: string, value: string>>"


def label_of(kv: str = "kv") -> Column:
    """The row's own label: the first label member with 1 to 80 characters."""
    return first_said(P.LABEL_KEYS, lambda m: let(F.trim(string_of(m)), lambda s: F.when((F.length(s) > 0) & (F.length(s) <= 80), s)), kv)


def first_wins(options: Column) -> Column:
    """Sorted options with the first value of each axis kept: array of ``axis``, ``value``."""

    def firsts(ordered: Column) -> Column:
        return let(F.transform(ordered, lambda p: p["axis"]), lambda axes: F.filter(ordered, lambda o, i: F.array_position(axes, o["axis"]) == i + 1))

    return F.transform(let(F.sort_array(options), firsts), lambda o: F.struct(o["axis"].alias("axis"), o["value"].alias("value")))


def _own_options() -> Column:
    """Axes that are members of the row itself."""

    def one(m: Column, i: Column) -> Column:
        def said(axis: Column) -> Column:
            own = let(scalar_of(m), lambda value: F.when(~is_null_choice(value), F.struct(F.lit(0).alias("prio"), i.alias("ord"), axis.alias("axis"), value.alias("value"))))
            return F.when(axis.isNotNull() & ~is_axis_id_key(m["k"]), own)

        return let(axis_of_key(m["k"]), said)

    return F.filter(F.transform("kv", one), lambda o: o["value"].isNotNull())


def positional_names(kv: str) -> Column:
    """Axes that an object lists for its rows' ``option1``, ``option2``, ...; null if it does not."""
    names = first_said(("options", "optionNames", "variesBy"), lambda v: F.when((v["kind"] == "list") & (F.size(v["items"]) > 0), v["items"]), kv)
    return F.transform(names, lambda item: axis_title(scalar_of(item)))


def _positional_options() -> Column:
    """``option1``, ``option2``, ... of the row against the names the parent lists."""

    def one(name: Column, i: Column) -> Column:
        value = scalar_of(member(F.concat(F.lit("option"), (i + 1).cast("string"))))
        return F.struct(F.lit(1).alias("prio"), i.alias("ord"), name.alias("axis"), value.alias("value"))

    return F.filter(F.transform("named", one), lambda o: o["axis"].isNotNull() & o["value"].isNotNull())


def row_options(rows: DataFrame, nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """``rows`` with ``options``: what each row says of its axes, by five conventions in order.

    Expects ``page_id``, ``table_id``, ``pos``, ``kv`` of the row, ``named`` (:func:`positional_names`) of its parent, ``axis`` of its list.
    """
    rows = reused(rows, "row-objects", buckets)
    said = rows.select("page_id", "table_id", "pos", F.inline(present(P.PAIR_KEYS)))
    kids = held_as(nodes, *P.PAIR_KEYS).select("page_id", F.col("n").alias("child"), F.col("kv").alias("ckv"))
    # Maps and lists of pairs are met in one join: a map is an object by itself.
    children = F.when(F.col("m.kind") == "obj", F.array("m.child")).when(F.col("m.kind") == "list", F.transform("m.items", lambda x: x["child"]))
    entries = said.select("page_id", "table_id", "pos", "key_ord", (F.col("m.kind") == "obj").alias("is_map"), F.posexplode(children).alias("spot", "child")).join(kids, ["page_id", "child"])

    def of_map(c: Column, i: Column) -> Column:
        return let(scalar_of(c), lambda v: F.struct(i.alias("i"), F.trim(c["k"]).alias("name"), F.when(~is_null_choice(v), v).alias("value")))

    of_list = F.struct(F.col("spot").alias("i"), first_said(("name", "key", "attribute"), scalar_of, "ckv").alias("name"), first_said(("value", "optionValue", "label"), scalar_of, "ckv").alias("value"))
    stating = F.when(F.col("is_map"), F.transform("ckv", of_map)).otherwise(F.array(of_list))
    pairs = entries.select("page_id", "table_id", "pos", "key_ord", F.inline(stating)).filter("name <> '' and value is not null and lower(name) <> lower(value)")
    axis = F.coalesce(axis_of_key(F.col("name")), F.initcap("name"))
    stated = pairs.groupBy("page_id", "table_id", "pos").agg(F.collect_list(F.struct(F.lit(2).alias("prio"), (F.col("key_ord") * 10_000 + F.col("i")).alias("ord"), axis.alias("axis"), F.col("value").alias("value"))).alias("paired"))
    joined = rows.join(stated, ["page_id", "table_id", "pos"], "left")
    none = F.array().cast(OPTION)
    several = first_wins(F.concat(_own_options().cast(OPTION), F.coalesce(_positional_options().cast(OPTION), none), F.coalesce(F.col("paired").cast(OPTION), none)))
    by_key = F.filter(F.transform("kv", lambda m: F.when(is_axis_id_key(m["k"]), axis_of_key(m["k"]))), lambda a: a.isNotNull())
    named = F.coalesce(F.try_element_at(by_key, F.lit(1)), F.col("axis"))
    # Asked of rows alone that say nothing of their axes otherwise.
    alone = let(F.struct(named.alias("axis"), label_of().alias("value")), lambda x: F.when(x["axis"].isNotNull() & x["value"].isNotNull(), F.array(x)).otherwise(F.array().cast("array<struct<axis: string, value: string>>")))
    return joined.withColumn("options", let(several, lambda xs: F.when(F.size(xs) > 0, xs).otherwise(alone))).drop("paired")


def identity(keys: tuple[str, ...]) -> Column:
    """The first of these members (any case) that is no address; of a list its first value."""

    def read(m: Column) -> Column:
        own = let(scalar_of(m), lambda v: F.when(~v.startswith("http"), v))
        return F.coalesce(own, F.when(m["kind"] == "list", scalar_of(F.try_element_at(m["items"], F.lit(1)))))

    return first_said(keys, read, any_case=True)


def availability(places: Column | None = None) -> Column:
    """Stock state of a row: its members in order, else ``places`` (stock summed over locations), else unknown."""
    state = first_said(P.ROW_STOCK_KEYS, lambda m: stock_of(m["kind"], m["s"], m["num"]))
    return F.coalesce(state, *([places] if places is not None else []), F.lit("unknown"))


def tables(nodes: DataFrame, ids: DataFrame, names: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of every list that looks like a table of variants.

    ``page_id``, ``table_id`` (object and member), ``path``, ``owned``, ``pos``, ``n``, ``row_path``, ``kv``, ``options``.
    """
    owner = nodes.join(ids.select("page_id", F.concat("url_tokens", "key_tokens").alias("tokens")), "page_id").join(names.select("page_id", F.lower(F.trim("name")).alias("page_name")), "page_id", "left")
    own_name = F.lower(F.trim(F.coalesce(scalar_of(member("name")), scalar_of(member("title")))))
    claims = F.transform(present(("sku", "mpn", "productID", "id", "url", "canonicalUrl")), lambda r: scalar_of(r["m"]))
    is_own = F.coalesce((F.col("page_name") != "") & (own_name == F.col("page_name")), F.lit(False)) | let(claims, lambda cs: F.exists("tokens", lambda t: (t != "") & F.exists(cs, lambda c: F.coalesce(c.contains(t), F.lit(False)))))
    # Only objects with a list are asked whose they are and what they name; their members stay behind.
    listing = owner.filter(F.exists("kv", lambda m: (m["kind"] == "list") & (F.size(m["items"]) >= 2)))
    lists = listing.select("page_id", "b", "n", "path", positional_names("kv").alias("named"), is_own.alias("owned"), F.posexplode("kv").alias("i", "m")).filter("m.kind = 'list'")
    objects = F.filter("m.items", lambda x: (x["kind"] == "obj") & x["child"].isNotNull())
    sized = lists.filter((F.size("m.items") >= 2) & (F.size("m.items") <= 400)).withColumn("objects", objects).filter((F.size("objects") >= 2) & (F.size("objects") >= 0.5 * F.size("m.items")))
    full = F.concat(F.lit("b"), F.col("b").cast("string"), F.when(F.col("path") != "", F.concat(F.lit("."), "path")).otherwise(""), F.lit("."), F.col("m.k"))
    placed = sized.withColumn("full", full).filter(~F.col("full").rlike(P.VARIANT_EXCLUDE))
    rows = placed.select("page_id", (F.col("n").cast("long") * 1_000_000 + F.col("i")).alias("table_id"), F.col("full").alias("path"), "owned", "named", axis_of_key(F.col("m.k")).alias("axis"), F.posexplode("objects").alias("pos", "x"))
    joined = rows.withColumn("child", F.col("x.child")).drop("x").join(nodes.filter(F.col("path").endswith("]")).select("page_id", F.col("n").alias("child"), F.col("last"), F.col("path").alias("row_path"), "kv"), ["page_id", "child"])
    told = row_options(joined, nodes, buckets)
    full_rows = Window.partitionBy("page_id", "table_id")
    counted = told.withColumn("n_rows", F.count("*").over(full_rows)).withColumn("n_said", F.count_if(F.size("options") > 0).over(full_rows))
    return counted.filter((F.col("n_said") >= 2) & (F.col("n_said") >= 0.5 * F.col("n_rows"))).withColumnRenamed("child", "n").drop("named", "axis", "n_said")


def pick_tables(rows: DataFrame) -> DataFrame:
    """``page_id``, ``table_id``, ``path``: the product's own tables, each once, without those another covers."""
    axes = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.transform("options", lambda o: o["axis"])))))
    known = (identity(P.ROW_ID_KEYS).isNotNull() | identity(P.GTIN_KEYS).isNotNull()).cast("int")
    head = F.sort_array(F.collect_list(F.when(F.col("pos") < 4, F.to_json("options"))))
    each = rows.groupBy("page_id", "table_id").agg(F.first("path").alias("path"), F.first("owned").alias("owned"), axes.alias("axes"), F.sum(known).alias("identified"), F.count("*").alias("n_rows"), head.alias("head"))
    page = Window.partitionBy("page_id")
    pool = each.withColumn("any_own", F.max("owned").over(page)).filter("owned or not any_own")
    same = Window.partitionBy("page_id", "axes", "n_rows", "head").orderBy(F.length("path"), "table_id")
    unique = pool.withColumn("k", F.row_number().over(same)).filter("k = 1")
    richest = Window.partitionBy("page_id", "axes").orderBy(F.col("identified").desc(), F.length("path"), "table_id")
    best = unique.withColumn("k", F.row_number().over(richest)).filter("k = 1").select("page_id", "table_id", "path", "axes")
    other = best.select(F.col("page_id").alias("p"), F.col("table_id").alias("t"), F.col("axes").alias("more"))
    covered = (best["page_id"] == other["p"]) & (F.size("axes") < F.size("more")) & (F.size(F.array_except("axes", "more")) == 0)
    return best.join(other, covered, "left_anti")


def table_variants(rows: DataFrame, picked: DataFrame, nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Distinct combinations of the picked tables in page order: ``page_id``, ``ord``, ``variant``."""
    kept = rows.join(picked.select("page_id", "table_id"), ["page_id", "table_id"]).filter(F.size("options") > 0)
    combo = F.to_json(F.sort_array("options"))
    once = Window.partitionBy("page_id", "combo").orderBy("table_id", "pos")
    kept = kept.withColumn("combo", combo).withColumn("k", F.row_number().over(once)).filter("k = 1").drop("k")
    kept = reused(kept, "combinations", buckets)
    money = first_said(P.PRICE_KEYS, lambda m: amount_of_value(m["kind"], m["s"], m["num"]))
    currency = first_said(P.CURRENCY_KEYS, lambda m: currency_of(string_of(m)))

    def picture(m: Column, i: Column) -> Column:
        shown = (m["kind"] == "str") & F.lower(m["k"]).isin(*P.ROW_IMAGE_KEYS) & U.is_image_url(m["s"])
        return F.when(shown, F.struct(F.col("n"), i.alias("i"), U.absolute(m["s"]).alias("u")))

    # Of an object only this is asked, once, before it is met with its rows; few objects have any of it.
    telling = nodes.filter(F.col("path").contains("]") & F.exists("kv", lambda m: m["k"].isin(*P.PRICE_KEYS) | F.lower(m["k"]).isin(*P.ROW_IMAGE_KEYS)))
    telling = telling.select("page_id", "n", "path", money.alias("x"), F.coalesce(currency, F.lit("USD")).alias("currency"), F.array_compact(F.transform("kv", picture)).alias("pics"))
    inner = inside(kept.select("page_id", "table_id", "pos", "row_path", F.col("n").alias("rn"), F.col("last").alias("rl")), telling, "rn", "rl").withColumn("rel", F.expr("substring(path, length(row_path) + 2)"))
    shallow = (F.length("rel") - F.length(F.replace("rel", F.lit("."), F.lit("")))) <= 2
    told = inner.groupBy("page_id", "table_id", "pos").agg(
        F.min_by(F.struct(F.col("x").alias("price"), "currency"), F.when(shallow & F.col("x").isNotNull(), F.col("n"))).alias("money"), F.sort_array(F.flatten(F.collect_list("pics"))).alias("xs")
    )
    told = told.select("page_id", "table_id", "pos", "money", F.slice(F.array_distinct(F.transform("xs", lambda x: x["u"])), 1, 12).alias("image_urls"))
    places = kept.select("page_id", "table_id", "pos", F.inline(present(P.STOCK_PLACES))).filter("m.kind = 'list'").select("page_id", "table_id", "pos", "key_ord", F.explode("m.items").alias("x"))
    held = places.select("page_id", "table_id", "pos", "key_ord", F.col("x.child").alias("child")).join(held_as(nodes, *P.STOCK_PLACES).select("page_id", F.col("n").alias("child"), member("stock").alias("st")), ["page_id", "child"]).filter("st is not null")
    summed = held.groupBy("page_id", "table_id", "pos", "key_ord").agg(F.sum(F.coalesce("st.num", F.lit(0.0))).alias("total"))
    summed = summed.groupBy("page_id", "table_id", "pos").agg(F.min_by(F.when(F.col("total") > 0, "in_stock").otherwise("out_of_stock"), "key_ord").alias("places"))
    keys = ["page_id", "table_id", "pos"]
    full = kept.join(told, keys, "left").join(summed, keys, "left")
    price = F.when(F.col("money").isNotNull(), F.struct(F.col("money.price").alias("price"), F.col("money.currency").alias("currency"), F.lit(None).cast("double").alias("compare_at_price")))
    variant = F.struct(
        identity(P.ROW_ID_KEYS).alias("sku"), F.map_from_entries("options").alias("options"), price.alias("price"),
        F.coalesce("image_urls", F.array().cast("array<string>")).alias("image_urls"), availability(F.col("places")).alias("availability"),
        identity(P.GTIN_KEYS).alias("gtin"), identity(P.MPN_KEYS).alias("mpn"),
    )
    return full.select("page_id", F.struct("table_id", "pos").alias("ord"), "options", variant.alias("variant"))


def axis_definitions(nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """The page's best table of axes with their choices, exploded.

    ``page_id``, ``axis_ord``, ``axis``, ``choice_ord``, ``choice``, ``skus``.
    """
    # An axis is an entry of a list that has a list of choices itself: few objects are, so that they are found first and then their list.
    entries = nodes.filter(F.col("path").endswith("]") & F.exists("kv", lambda m: m["k"].isin(*P.CHOICE_KEYS) & (m["kind"] == "list") & (F.size(m["items"]) >= 2)))
    goods = F.size(F.array_distinct(F.filter(F.transform("kv", lambda m: F.lower(m["k"])), lambda k: k.isin(*P.PRODUCT_ONLY_KEYS)))) >= 2
    several = first_said(P.CHOICE_KEYS, lambda m: let(F.filter(m["items"], lambda x: x["kind"] == "obj"), lambda xs: F.when(F.size(xs) >= 2, xs)))
    said = let(label_of(), lambda axis: F.when(F.length(axis) <= 40, let(several, lambda xs: F.when(xs.isNotNull(), F.struct(axis.alias("axis"), xs.alias("choices"))))))
    stating = entries.filter(~goods).select("page_id", F.col("n").alias("child"), F.col("parent").alias("holder"), "parent_key", said.alias("x")).filter("x is not null").select("page_id", "child", "holder", "parent_key", "x.axis", "x.choices")
    holders = nodes.filter(F.exists("kv", lambda m: (m["kind"] == "list") & (F.size(m["items"]) >= 1) & (F.size(m["items"]) <= 20))).select("page_id", "b", F.col("n").alias("holder"), "path", "kv")
    full = F.concat(F.lit("b"), F.col("b").cast("string"), F.when(F.col("path") != "", F.concat(F.lit("."), "path")).otherwise(""), F.lit("."), F.col("parent_key"))
    listed = stating.join(holders, ["page_id", "holder"]).withColumn("m", member(F.col("parent_key"))).filter((F.col("m.kind") == "list") & (F.size("m.items") >= 1) & (F.size("m.items") <= 20) & ~full.rlike(P.VARIANT_EXCLUDE))
    spot = F.array_position(F.transform("kv", lambda m: m["k"]), F.col("parent_key")) - 1
    axis_ord = (F.array_position(F.transform("m.items", lambda x: x["child"]), F.col("child")) - 1).cast("int")
    axes = listed.select("page_id", F.struct(F.col("holder").alias("n"), spot.cast("int").alias("i")).alias("tab"), axis_ord.alias("axis_ord"), "axis", "choices").filter("axis_ord >= 0")
    kids = held_as(nodes, *P.CHOICE_KEYS).select("page_id", F.col("n").alias("child"), "kv")
    picks = axes.select("page_id", "tab", "axis_ord", "axis", F.posexplode("choices").alias("choice_ord", "x")).select("page_id", "tab", "axis_ord", "axis", "choice_ord", F.col("x.child").alias("child")).join(kids, ["page_id", "child"])

    def sku_list(m: Column) -> Column:
        found = F.filter(F.transform(m["items"], string_of), lambda s: (F.length(s) > 1) & (F.length(s) < 60))
        return let(found, lambda xs: F.when(F.size(xs) > 0, xs))

    skus = F.coalesce(first_said(P.SKU_SET_KEYS, sku_list), F.array().cast("array<string>"))
    labelled = picks.select("page_id", "tab", "axis_ord", "axis", "choice_ord", label_of().alias("choice"), skus.alias("skus")).filter("choice is not null").filter(~is_null_choice(F.col("choice")))
    enough = Window.partitionBy("page_id", "tab", "axis_ord")
    full_axes = labelled.withColumn("c", F.count("*").over(enough)).filter("c >= 2").drop("c")
    full_axes = reused(full_axes, "axis-choices", buckets)
    ranked = full_axes.groupBy("page_id", "tab").agg(F.countDistinct("axis_ord").alias("n_axes"), F.max(axis_of_key(F.col("axis")).isNotNull()).alias("known")).filter("known")
    best = ranked.groupBy("page_id").agg(F.min_by("tab", F.struct((-F.col("n_axes")).alias("m"), F.col("tab").alias("t"))).alias("tab"))
    return full_axes.join(best, ["page_id", "tab"]).drop("tab")


def sku_join(definitions: DataFrame) -> DataFrame:
    """``page_id``, ``sku``, ``options``: articles that have a value on every axis (relational division)."""
    axes = definitions.groupBy("page_id").agg(F.countDistinct("axis").alias("n_axes"))
    said = definitions.select("page_id", "axis_ord", "axis", "choice_ord", "choice", F.posexplode("skus").alias("i", "sku"))
    last = said.groupBy("page_id", "sku", "axis").agg(F.max_by("choice", F.struct("axis_ord", "choice_ord")).alias("value"), F.min(F.struct("axis_ord", "choice_ord", "i")).alias("at"))
    found = last.groupBy("page_id", "sku").agg(F.count("*").alias("n"), F.min("at").alias("ord"), F.sort_array(F.collect_list(F.struct("at", "axis", "value"))).alias("xs"))
    complete = found.join(axes, "page_id").filter("n = n_axes")
    return complete.select("page_id", "ord", "sku", F.transform("xs", lambda x: F.struct(x["axis"].alias("axis"), x["value"].alias("value"))).alias("options"))


VARIANT = (
    "struct<sku: string, options: map<string, string>, price: struct<price: double, currency: string, compare_at_price: double>, "
    "image_urls: array<string>, availability: string, gtin: string, mpn: string>"
)


def axis_values(variants: DataFrame) -> DataFrame:
    """``page_id``, ``options``: axes with their values in the order the page gives them."""
    said = variants.select("page_id", "ord", F.posexplode("options").alias("i", "o")).select("page_id", F.col("o.axis").alias("axis"), F.col("o.value").alias("value"), F.struct("ord", "i").alias("at"))
    values = said.groupBy("page_id", "axis", "value").agg(F.min("at").alias("at"))
    axes = values.groupBy("page_id", "axis").agg(F.min("at").alias("first"), F.sort_array(F.collect_list(F.struct("at", "value"))).alias("xs"))
    listed = axes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("first", "axis", F.transform("xs", lambda x: x["value"]).alias("values")))).alias("ys"))
    return listed.select("page_id", F.transform("ys", lambda y: F.struct(y["axis"].alias("name"), y["values"].alias("values"))).alias("options"))


def derive(parsed: DataFrame, nodes: DataFrame, ids: DataFrame, names: DataFrame, products: DataFrame, buckets: int | None = None) -> DataFrame:
    """``page_id``, ``options``, ``variants``, ``colors``; a page without variants has one with its article number."""
    rows = kept(tables(nodes, ids, names, buckets), "variant-rows", buckets)
    listed = kept(table_variants(rows, pick_tables(rows), nodes, buckets), "variants", buckets)
    definitions = kept(axis_definitions(nodes, buckets), "axes", buckets)
    found_axes = listed.select("page_id", F.explode("options").alias("o")).groupBy("page_id").agg(F.countDistinct("o.axis").alias("found"))
    more = definitions.groupBy("page_id").agg(F.countDistinct("axis").alias("n_axes")).join(found_axes, "page_id", "left").filter("n_axes > coalesce(found, 0)").select("page_id")
    joined = sku_join(definitions.join(more, "page_id"))
    empty = F.array().cast("array<string>")

    def bare(sku: Column, options: Column) -> Column:
        return F.struct(sku.alias("sku"), options.alias("options"), F.lit(None).cast("struct<price: double, currency: string, compare_at_price: double>").alias("price"), empty.alias("image_urls"), F.lit("unknown").alias("availability"), F.lit(None).cast("string").alias("gtin"), F.lit(None).cast("string").alias("mpn"))

    cols = ["page_id", "ord", "options", "variant"]
    at = F.struct(F.col("ord.axis_ord").cast("long").alias("table_id"), (F.col("ord.choice_ord") * 100_000 + F.col("ord.i")).cast("int").alias("pos")).alias("ord")
    of_skus = joined.select("page_id", at, "options", bare(F.col("sku"), F.map_from_entries("options")).alias("variant"))
    every = listed.join(more, "page_id", "left_anti").select(*cols).union(of_skus.select(*cols))
    every = reused(every, "all-variants", buckets)
    # Maps do not compare, so variants are put in order by their keys.
    grouped = every.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "variant"))).alias("vs"))
    ordered = grouped.select("page_id", F.transform(F.sort_array(F.map_keys("vs")), lambda k: F.element_at("vs", k)).alias("variants"))
    values = axis_values(every)
    declared = definitions.join(more, "page_id").groupBy("page_id", "axis_ord", "axis").agg(F.sort_array(F.collect_list(F.struct("choice_ord", "choice"))).alias("cs"))
    declared = declared.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("axis_ord", "axis", F.transform("cs", lambda c: c["choice"]).alias("values")))).alias("xs"))
    declared = declared.select("page_id", F.transform("xs", lambda x: F.struct(x["axis"].alias("name"), x["values"].alias("values"))).alias("declared"))
    sku = products.withColumn("s", string_of(member("sku"))).filter("s is not null").groupBy("page_id").agg(F.min_by("s", "rk").alias("fallback_sku"))
    full = parsed.select("page_id").join(ordered, "page_id", "left").join(values, "page_id", "left").join(declared, "page_id", "left").join(sku, "page_id", "left")
    no_axes = F.array().cast("array<struct<name: string, values: array<string>>>")
    single = F.array(bare(F.col("fallback_sku"), F.create_map().cast("map<string, string>")).cast(VARIANT))
    options = F.coalesce("declared", F.col("options").cast("array<struct<name: string, values: array<string>>>"), no_axes)
    out = full.select("page_id", options.alias("options"), F.coalesce(F.col("variants").cast(f"array<{VARIANT}>"), single).alias("variants"))
    return out.withColumn("colors", F.coalesce(F.try_element_at(F.filter("options", lambda o: o["name"] == "Color"), F.lit(1))["values"], empty))


def match_variant(variants: Column, options: Column, selection: Column) -> Column:
    """The variant of a full selection (a map), null while it is incomplete; the first if there is nothing to select."""
    hits = F.filter(variants, lambda v: F.forall(F.map_entries(selection), lambda e: F.coalesce(F.try_element_at(v["options"], e["key"]) == e["value"], F.lit(False))))
    chosen = F.when(F.size(F.map_keys(selection)) == F.size(options), F.try_element_at(hits, F.lit(1)))
    return F.when(F.size(options) == 0, F.try_element_at(variants, F.lit(1))).otherwise(chosen)


def reachable(variants: Column, axis: Column, selection: Column) -> Column:
    """Values of an axis that some variant in stock still allows, given the choices on the other axes."""
    others = F.filter(F.map_entries(selection), lambda e: e["key"] != axis)
    usable = F.filter(
        variants,
        lambda v: ~v["availability"].isin("out_of_stock", "discontinued") & F.forall(others, lambda e: F.coalesce(F.try_element_at(v["options"], e["key"]) == e["value"], F.lit(True))),
    )
    return F.sort_array(F.array_distinct(F.filter(F.transform(usable, lambda v: F.try_element_at(v["options"], axis)), lambda x: x.isNotNull())))
