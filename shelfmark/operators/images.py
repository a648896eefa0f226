"""Product images: candidates, whose they are, and the best rendition of each; and the one video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions import urls as U
from shelfmark.functions.text import strip, unescape_common
from shelfmark.operators import dom as D
from shelfmark.operators.graph import present, scored, string_of
from shelfmark.sources.stages import reused

URL = "page_id long, base string"


def page_urls(dom: DataFrame) -> DataFrame:
    """``page_id``, ``base`` (canonical URL), ``url_tokens``: path segments with a digit of it and of ``og:url``."""
    both = D.canonical_url(dom).join(D.metas(dom, "url"), "page_id", "full")
    tokens = F.concat(*[F.coalesce(U.identity_tokens(unescape_common(F.col(c))), F.array().cast("array<string>")) for c in ("url", "meta_url")])
    return both.select("page_id", F.col("url").alias("base"), F.slice(F.array_distinct(tokens), 1, 8).alias("url_tokens"))


def key_tokens(nodes: DataFrame) -> DataFrame:
    """``page_id``, ``key_tokens``: ids with a digit in document order, twelve at most."""
    found = nodes.select("page_id", "n", F.inline(present(P.IDENTITY_KEYS)))
    said = found.select("page_id", "n", F.col("key_ord").alias("i"), string_of(F.col("m")).alias("v")).filter((F.length("v") > 2) & (F.length("v") < 40) & ~F.col("v").startswith("http") & F.col("v").rlike(r"\d"))
    first = said.groupBy("page_id", "v").agg(F.min(F.struct("n", "i")).alias("at"))
    listed = first.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("xs"))
    return listed.select("page_id", F.slice(F.transform("xs", lambda x: x["v"]), 1, 12).alias("key_tokens"))


def identities(parsed: DataFrame, dom: DataFrame, nodes: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    joined = parsed.select("page_id").join(page_urls(dom), "page_id", "left").join(key_tokens(nodes), "page_id", "left")
    return joined.select("page_id", "base", F.coalesce("url_tokens", none).alias("url_tokens"), F.coalesce("key_tokens", none).alias("key_tokens"))


def json_image_strings(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """``page_id``, ``path``, ``s``, ``from_key``, ``ord``: image strings of objects and of lists in document order."""
    m = F.col("m")
    full = F.concat(F.lit("b"), F.col("b").cast("string"), F.lit("."), F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), m["k"])
    linked = nodes.filter(F.exists("kv", lambda m: (m["kind"] == "str") & (m["s"].startswith("http") | m["s"].startswith("//"))))
    members = linked.select("page_id", "b", "n", "path", F.posexplode("kv").alias("i", "m")).filter(m["kind"] == "str")
    fits = U.is_image_url(m["s"]) & (F.lower(m["k"]).isin(*P.IMAGE_KEYS) | m["s"].rlike(P.IMAGE_EXTENSION))
    keyed = members.filter(fits).select("page_id", full.alias("path"), m["s"].alias("s"), F.lit(True).alias("from_key"), F.struct("b", "n", "i").alias("ord"))
    spot = F.concat(F.lit("b"), F.col("b").cast("string"), F.when(F.col("path").startswith("["), "").otherwise("."), F.col("path"))
    listed = strings.filter(U.is_image_url(F.col("s"))).select("page_id", spot.alias("path"), "s", F.lit(False).alias("from_key"), F.struct("b", F.col("ord").alias("n"), (F.lit(1_000_000) + F.col("pos")).alias("i")).alias("ord"))
    return keyed.unionByName(listed)


def candidates(dom: DataFrame, nodes: DataFrame, strings: DataFrame, ids: DataFrame) -> DataFrame:
    """``page_id``, ``path``, ``url``, ``markup``, ``ord``: every image the page states, less other modules' ones."""
    tags = dom.filter(F.col("tag").isin("img", "source") & ~F.coalesce(F.col("ctx8").rlike(P.IMAGE_EXCLUDE), F.lit(False)))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), D.attribute(a).alias("raw")) for i, a in enumerate(P.IMAGE_ATTRIBUTES)])
    raw = tags.select("page_id", "nid", F.inline(parts)).filter("raw is not null").select("page_id", "nid", "i", "a", F.posexplode(F.split("raw", ",")).alias("p", "part"))
    one = raw.withColumn("part", F.regexp_extract(strip(F.col("part")), rf"\A[^{P.WS}]+", 0)).filter("part <> ''")
    marked = one.select("page_id", F.concat(F.lit("markup."), "a").alias("path"), "part", F.struct(F.lit(0).alias("s"), F.col("nid").alias("a"), F.col("i").alias("b"), F.col("p").alias("c"), F.lit(0).alias("d")).alias("ord"))
    metas = D.metas(dom, "image", "image:secure_url")
    og = metas.select("page_id", F.posexplode(F.array("meta_image", "meta_image_secure_url")).alias("i", "part")).filter("part is not null")
    og = og.select("page_id", F.lit("markup.og").alias("path"), "part", F.struct(F.lit(1).alias("s"), F.col("i").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("ord"))
    js = json_image_strings(nodes, strings).select("page_id", "path", F.posexplode(U.split_srcset(F.col("s"))).alias("p", "part"), "ord").filter(U.is_image_url(F.col("part")))
    js = js.select("page_id", "path", "part", F.struct(F.lit(2).alias("s"), F.col("ord.b").alias("a"), F.col("ord.n").alias("b"), F.col("ord.i").alias("c"), F.col("p").alias("d")).alias("ord"))
    every = marked.unionByName(og).unionByName(js).join(ids.select("page_id", "base"), "page_id")
    url = U.absolute(unescape_common(F.col("part")), F.coalesce("base", F.lit("")))
    found = every.select("page_id", "path", url.alias("url"), F.col("path").startswith("markup").alias("markup"), "ord").filter(U.is_image_url(F.col("url")))
    return found.filter(~F.col("path").rlike(P.IMAGE_EXCLUDE) & ~F.col("url").rlike(P.IMAGE_EXCLUDE))


def owned(found: DataFrame, ids: DataFrame, best_path: DataFrame) -> DataFrame:
    """Of each page the candidates of the strongest claim of ownership with two members, else with one."""
    segments = F.split("path", r"[.\[\]]+")
    joined = found.join(ids.select("page_id", "url_tokens", "key_tokens"), "page_id").join(best_path, "page_id", "left")
    by_url = F.exists("url_tokens", lambda t: F.col("url").contains(t))
    tiers = [
        ~F.col("markup") & by_url, ~F.col("markup") & F.arrays_overlap(segments, F.col("key_tokens")),
        ~F.col("markup") & F.coalesce((F.col("best_path") != "") & F.col("path").startswith(F.col("best_path")), F.lit(False)),
        ~F.col("markup"), F.col("markup") & by_url, F.col("markup"),
    ]
    marked = joined.withColumn("tiers", F.filter(F.array(*[F.when(t, i) for i, t in enumerate(tiers)]), lambda t: t.isNotNull()))
    counted = marked.select("page_id", F.explode("tiers").alias("tier")).groupBy("page_id", "tier").count()
    chosen = counted.groupBy("page_id").agg(F.coalesce(F.min(F.when(F.col("count") >= 2, F.col("tier"))), F.min("tier")).alias("tier"))
    return marked.join(chosen, "page_id").filter(F.array_contains("tiers", F.col("tier"))).drop("tiers")


def preload_hints(dom: DataFrame) -> DataFrame:
    """``page_id``, ``hints``: identities of images that the page preloads."""
    rel = F.lower(D.attribute("rel"))
    tags = dom.filter("tag = 'link'").filter((rel.contains("preload") | rel.contains("prefetch")) & (F.lower(D.attribute("as")) == "image"))
    raw = tags.select("page_id", F.explode(F.split(F.coalesce(F.nullif(D.attribute("href"), F.lit("")), D.attribute("imagesrcset")), ",")).alias("part"))
    url = U.absolute(F.regexp_extract(strip(F.col("part")), rf"\A[^{P.WS}]+", 0))
    return raw.select("page_id", url.alias("u")).filter(U.is_image_url(F.col("u"))).groupBy("page_id").agg(F.collect_set(U.identity_key(F.col("u"))).alias("hints"))


def in_best_container(kept: DataFrame, hints: DataFrame) -> DataFrame:
    """Of each page the candidates of its best gallery, if one holds two assets; else all."""
    none = F.array().cast("array<string>")
    told = kept.join(hints, "page_id", "left").withColumn("hints", F.coalesce("hints", none)).withColumn("boundary", U.asset_boundary(F.col("path"))).withColumn("container", F.regexp_replace("boundary", r"\[\d+\]$", ""))
    rank = F.struct(
        F.max(F.arrays_overlap(F.split("container", r"[.\[\]]+"), F.col("key_tokens")).cast("int")).alias("own"),
        F.max(F.array_contains("hints", U.identity_key(F.col("url"))).cast("int")).alias("hinted"),
        F.countDistinct("boundary").alias("assets"),
    )
    groups = told.filter("container is not null").groupBy("page_id", "container").agg(rank.alias("r"), F.min("ord").alias("first"))
    order = Window.partitionBy("page_id").orderBy(F.col("r").desc(), "first")
    best = groups.withColumn("k", F.row_number().over(order)).filter("k = 1 and r.assets >= 2").select("page_id", F.col("container").alias("best"))
    return told.join(best, "page_id", "left").filter("best is null or container = best").drop("best")


def best_renditions(kept: DataFrame) -> DataFrame:
    """One URL per asset: of equal identity the largest, preloaded ones first; ``page_id``, ``image_urls``.

    Expects ``page_id``, ``path``, ``url``, ``boundary``, ``hints``, ``ord``.
    """
    size = F.struct(U.ladder_rank(F.col("path")).alias("rung"), U.dimensions(F.col("url")).alias("px"), F.col("ord").alias("ord"))
    group = F.coalesce("boundary", U.identity_key(F.col("url")))
    assets = kept.groupBy("page_id", group.alias("asset")).agg(F.max_by("url", size).alias("url"), F.min("ord").alias("ord"), F.first("hints").alias("hints"))
    keyed = assets.withColumn("key", U.identity_key(F.col("url"))).withColumn("px", U.dimensions(F.col("url")))
    order = Window.partitionBy("page_id", "key").orderBy(F.col("px").desc(), "ord")
    final = keyed.withColumn("k", F.row_number().over(order)).filter("k = 1")
    late = (~F.array_contains("hints", F.col("key"))).cast("int")
    rows = F.sort_array(F.collect_list(F.struct(late.alias("late"), "ord", "url")))
    return final.groupBy("page_id").agg(F.array_distinct(F.transform(rows, lambda x: x["url"])).alias("image_urls"))


def resolve(dom: DataFrame, nodes: DataFrame, strings: DataFrame, ids: DataFrame, buckets: int | None = None) -> DataFrame:
    shaped = scored(nodes).groupBy("page_id").agg(F.max_by("path", F.struct(F.col("score").alias("s"), (-F.col("n")).alias("n"))).alias("best_path"))
    found = reused(candidates(dom, nodes, strings, ids), "image-candidates", buckets)
    kept = reused(owned(found, ids, shaped), "own-images", buckets)
    return best_renditions(in_best_container(kept, preload_hints(dom)))


def _declares_video() -> Column:
    return F.exists("kv", lambda m: F.lower(m["k"]).isin(*P.VIDEO_TYPE_KEYS) & (m["kind"] == "str") & m["s"].rlike(r"(?i)\bvideo\b"))


def resolve_video(dom: DataFrame, nodes: DataFrame, ids: DataFrame, buckets: int | None = None) -> DataFrame:
    """``page_id``, ``video_url``; null where several clips have no tie-break."""
    m = F.col("m")
    shown = nodes.filter(F.exists("kv", lambda m: (m["kind"] == "str") & F.lower(m["k"]).isin(*P.VIDEO_KEYS)))
    said = shown.select("page_id", "b", "n", "path", _declares_video().alias("declared"), F.posexplode("kv").alias("i", "m")).filter(m["kind"] == "str").filter(F.lower(m["k"]).isin(*P.VIDEO_KEYS))
    linked = m["s"].startswith("http") | m["s"].startswith("//")
    js = said.filter(U.is_video_url(m["s"]) | (F.col("declared") & linked & ~U.is_image_url(m["s"])))
    full = F.concat(F.lit("b"), F.col("b").cast("string"), F.lit("."), F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), m["k"])
    js = js.select("page_id", full.alias("path"), U.absolute(unescape_common(m["s"])).alias("url"), F.struct(F.lit(0).alias("s"), F.col("n").alias("a"), F.col("i").alias("b")).alias("ord"))
    tags = dom.filter(F.col("tag").isin("video", "source") & ~F.coalesce(F.col("ctx8").rlike(P.IMAGE_EXCLUDE), F.lit(False)))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.nullif(D.attribute(a), F.lit("")).alias("raw")) for i, a in enumerate(P.VIDEO_ATTRIBUTES)])
    raw = tags.select("page_id", "nid", "tag", F.lower(F.coalesce(D.attribute("type"), F.lit(""))).alias("mime"), F.inline(parts)).filter("raw is not null").join(ids.select("page_id", "base"), "page_id")
    url = U.absolute(unescape_common(F.col("raw")), F.coalesce("base", F.lit("")))
    marked = raw.filter(U.is_video_url(url) | F.col("mime").startswith("video/")).select("page_id", F.concat(F.lit("markup."), "tag", F.lit("."), "a").alias("path"), url.alias("url"), F.struct(F.lit(1).alias("s"), F.col("nid").alias("a"), F.col("i").alias("b")).alias("ord"))
    metas = D.metas(dom, "video", "video:url", "video:secure_url").select("page_id", F.posexplode(F.array("meta_video", "meta_video_url", "meta_video_secure_url")).alias("i", "u")).filter(U.is_video_url(F.col("u")))
    og = metas.select("page_id", F.lit("markup.og").alias("path"), U.absolute(F.col("u")).alias("url"), F.struct(F.lit(2).alias("s"), F.col("i").alias("a"), F.lit(0).alias("b")).alias("ord"))
    every = js.unionByName(marked).unionByName(og).filter(~F.col("path").rlike(P.IMAGE_EXCLUDE) & ~F.col("url").rlike(P.IMAGE_EXCLUDE))
    every = reused(every, "clips", buckets).join(ids, "page_id")
    by_url = F.exists("url_tokens", lambda t: F.col("url").contains(t))
    tier = F.when(by_url, 0).when(F.arrays_overlap(F.split("path", r"[.\[\]]+"), F.col("key_tokens")), 1).when(F.col("path").startswith("markup"), 2).otherwise(3)
    told = every.withColumn("tier", tier).withColumn("by_url", by_url)
    best = told.groupBy("page_id").agg(F.min("tier").alias("tier"))
    kept = told.join(best, ["page_id", "tier"]).groupBy("page_id").agg(F.countDistinct(U.identity_key(F.col("url"))).alias("clips"), F.max("by_url").alias("by_url"), F.min_by("url", "ord").alias("url"))
    return kept.select("page_id", F.when((F.col("clips") == 1) | F.col("by_url"), F.col("url")).alias("video_url"))
