"""JSON objects: how product-shaped they are, which name which, and what they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.binding import let
from shelfmark.functions.text import clean_text, collapse, strip, type_name
from shelfmark.sources.stages import staged


def member(key: str | Column, kv: str = "kv") -> Column:
    """The member of that name (names are unique in an object), or null."""
    if isinstance(key, str):
        return F.expr(f"try_element_at(filter({kv}, m -> m.k = '{key}'), 1)")
    return F.try_element_at(F.filter(kv, lambda m: m["k"] == key), F.lit(1))


def members(keys: tuple[str, ...], kv: str = "kv", any_case: bool = False) -> Column:
    """An array with a struct ``key_ord``, ``k``, ``m`` for each key; ``m`` is the member of that name, or null.

    One expression however many keys: what reads the members is planned once and not once a key.  All
    members are met once, and only those of a wanted name once a key.
    """
    listed = ", ".join(f"'{k.lower() if any_case else k}'" for k in keys)
    name = "lower(m.k)" if any_case else "m.k"
    wanted = f"filter({kv}, m -> {name} IN ({listed}))"
    return F.expr(f"element_at(transform(array({wanted}), few -> transform(array({listed}), (key, i) -> struct(i AS key_ord, key AS k, try_element_at(filter(few, m -> {name} = key), 1) AS m))), 1)")


def present(keys: tuple[str, ...], kv: str = "kv", any_case: bool = False) -> Column:
    """:func:`members` without those that are missing: an object has few of the wanted names, and only these cost."""
    listed = ", ".join(f"'{k.lower() if any_case else k}'" for k in keys)
    name = "lower(m.k)" if any_case else "m.k"
    wanted = f"filter({kv}, m -> {name} IN ({listed}))"
    if any_case:  # of names that differ in case alone the first
        wanted = f"element_at(transform(array({wanted}), few -> filter(few, (m, i) -> array_position(transform(few, x -> lower(x.k)), lower(m.k)) = i + 1)), 1)"
    return F.expr(f"sort_array(transform({wanted}, m -> struct(CAST(array_position(array({listed}), {name}) - 1 AS INT) AS key_ord, {name} AS k, m AS m)))")


def first_said(keys: tuple[str, ...], read: Callable[[Column], Column], kv: str = "kv", any_case: bool = False) -> Column:
    """``read`` of the first of these members for which it is not null."""
    return F.get(F.array_compact(F.transform(present(keys, kv, any_case), lambda r: read(r["m"]))), F.lit(0))


def has_any(keys: tuple[str, ...], kv: str = "kv") -> Column:
    """Whether an object has a member of one of these names: what a costlier question is asked of at all."""
    return F.exists(kv, lambda m: m["k"].isin(*keys))


def held_as(nodes: DataFrame, *keys: str) -> DataFrame:
    """Objects that another one holds under one of these names, itself or in a list: all that its members of these names can mean."""
    return nodes.filter(F.col("parent_key").isin(*keys)) if "parent_key" in nodes.columns else nodes


def string_of(m: Column) -> Column:
    return let(m, lambda v: F.when(v["kind"] == "str", v["s"]))


def cleaned(m: Column) -> Column:
    """A string or number as presentable text; booleans read as words."""
    return let(m, lambda v: F.when(v["kind"] == "str", clean_text(v["s"], v["decoded"])).when(v["kind"] == "num", v["s"]).when(v["kind"] == "bool", F.initcap(v["s"])))


def scalar_of(m: Column) -> Column:
    """The value, or the label of an object: 80 characters."""

    def read(v: Column) -> Column:
        plain = F.nullif(F.substring(strip(v["s"]), 1, 80), F.lit(""))
        return F.when(v["kind"] == "str", plain).when(v["kind"] == "num", v["s"]).when(v["kind"] == "obj", v["label"])

    return let(m, read)


def declared_type(kv: str = "kv") -> Column:
    raw = F.lower(F.coalesce(string_of(member("@type", kv)), F.lit("")))
    return F.element_at(F.split(F.regexp_replace(raw, "/+$", ""), "/"), -1)


def score(kv: str = "kv") -> Column:
    """Members with commerce names, plus six for a declared product type."""
    named = F.size(F.filter(kv, lambda m: F.lower(m["k"]).isin(*P.SIGNAL_KEYS)))
    return named + F.when(declared_type(kv).isin(*P.PRODUCT_TYPES), 6).otherwise(0)


def scored(nodes: DataFrame) -> DataFrame:
    """``nodes`` with :func:`score` as a column, unless they have it."""
    return nodes if "score" in nodes.columns else nodes.withColumn("score", score())


def product_nodes(nodes: DataFrame, least: int = P.LEAST_SCORE) -> DataFrame:
    """Objects of at least that score with their rank ``rk``: subjects before members, then by score, then in document order."""
    shaped = scored(nodes).filter(F.col("score") >= least).withColumn("is_member", F.col("path").rlike(P.MEMBER_PATH))
    order = Window.partitionBy("page_id").orderBy("is_member", F.col("score").desc(), "b", "n")
    return shaped.withColumn("rk", F.row_number().over(order))


#: Objects are met through stretches of so many numbers, not page against page; intervals of more stretches than this are met by page.
STRETCH, MOST_STRETCHES = 128, 64


def inside(outer: DataFrame, nodes: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of ``outer`` with the objects of their page numbered from ``first`` to ``last``.

    A row is filed under every stretch of numbers that its interval touches and an object under its
    own, so that a page of many objects is not compared each with each.  The few intervals that hold
    thousands of objects are filed once, under a stretch of the whole page that every object is in.
    """
    wide = F.col(last) - F.col(first) >= STRETCH * MOST_STRETCHES
    touched = F.when(wide, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.floor(F.col(first) / STRETCH), F.floor(F.when(wide, F.col(first)).otherwise(F.col(last)) / STRETCH)))
    own = F.array(F.lit(-1).cast("long"), F.floor(F.col("n") / STRETCH))
    met = outer.withColumn("stretch", F.explode(touched)).join(nodes.withColumn("stretch", F.explode(own)), ["page_id", "stretch"])
    return met.filter(f"n >= {first} and n <= {last}").drop("stretch")


def id_store(nodes: DataFrame) -> DataFrame:
    """``page_id``, ``ident``, ``n``: the first object that bears each id."""
    found = nodes.select("page_id", "n", F.inline(present(P.ID_FIELDS)))
    said = found.select("page_id", "n", "key_ord", string_of(F.col("m")).alias("ident")).filter((F.length("ident") > 1) & (F.length("ident") < 120))
    return said.groupBy("page_id", "ident").agg(F.min_by("n", F.struct("n", "key_ord")).alias("n"))


def reference_edges(nodes: DataFrame) -> DataFrame:
    """``page_id``, ``n``, ``k``, ``target``: members that name another object of the page."""
    store = id_store(nodes).select("page_id", F.col("ident").alias("s"), F.col("n").alias("target"))
    said = nodes.select("page_id", "n", F.explode("kv").alias("m")).filter("m.kind = 'str'")
    named = said.filter(F.col("m.k").rlike(P.REFERENCE_KEY) | F.col("m.k").isin("__ref", "__typename_ref")).select("page_id", "n", "m.k", "m.s")
    return named.join(store, ["page_id", "s"]).select("page_id", "n", "k", "target")


def closure(edges: DataFrame, depth: int = 8) -> DataFrame:
    """``page_id``, ``origin``, ``n``, ``steps``: what is reached over references in at most ``depth`` steps, and in how few.

    Level by level: what a level reaches for the first time is the frontier of the next, so that a
    circle ends and no way is walked twice.  An object does not reach itself.
    """
    step = staged(edges.select("page_id", F.col("n").alias("src"), F.col("target").alias("dst")).filter("src <> dst").distinct(), "reference-steps")
    frontier = step.select("page_id", F.col("src").alias("origin"), F.col("dst").alias("n"), F.lit(1).alias("steps"))
    reached = frontier
    for steps in range(2, depth + 1):
        met = frontier.join(step, (frontier["page_id"] == step["page_id"]) & (frontier["n"] == step["src"])).select(frontier["page_id"], "origin", F.col("dst").alias("n")).filter("n <> origin").distinct()
        frontier = staged(met.join(reached, ["page_id", "origin", "n"], "left_anti").withColumn("steps", F.lit(steps)), "reference-steps")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def graph_breadcrumbs(nodes: DataFrame) -> DataFrame:
    """``page_id``, ``trail``: names of the first breadcrumb list with two entries."""
    said = string_of(member("@type"))
    typed = F.exists("kv", lambda m: (m["k"] == "@type") & (m["kind"] == "str") & F.lower(m["s"]).contains("breadcrumb"))
    lists = nodes.filter(typed & F.lower(type_name(said)).isin(*P.BREADCRUMB_TYPES))
    listed = F.coalesce(F.nullif(F.size(member("itemListElement")["items"]), F.lit(-1)), F.lit(0)) > 0
    direct = F.when(member("itemListElement")["kind"] == "obj", F.array(member("itemListElement")["child"]))
    many = F.transform(F.when(listed, member("itemListElement")["items"]).otherwise(member("_child")["items"]), lambda x: x["child"])
    one = F.when(member("_child")["kind"] == "obj", F.array(member("_child")["child"]))
    entries = lists.select("page_id", "b", F.col("n").alias("list_n"), F.posexplode(F.coalesce(direct, many, one)).alias("pos", "n")).filter("n is not null")
    named = entries.join(held_as(nodes, "itemListElement", "_child").select("page_id", "n", "kv"), ["page_id", "n"])
    own = F.coalesce(string_of(member("name")), string_of(member("title")))
    inner = F.coalesce(member("name")["child"], member("item")["child"])
    of_inner = held_as(nodes, "name", "item").select("page_id", F.col("n").alias("inner"), string_of(member("name")).alias("inner_name"))
    full = named.select("page_id", "list_n", "pos", own.alias("own"), F.when(own.isNull(), inner).alias("inner")).join(of_inner, ["page_id", "inner"], "left")
    labels = full.withColumn("t", collapse(F.coalesce("own", "inner_name"))).filter("t <> ''")
    trails = labels.groupBy("page_id", "list_n").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("xs")).filter(F.size("xs") >= 2)
    return trails.groupBy("page_id").agg(F.min_by(F.transform("xs", lambda x: x["t"]), "list_n").alias("trail"))
