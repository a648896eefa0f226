"""URL filter: explicit host and path rules, and a tree of path templates per host.  DataFrame only.

The paths of a host form a tree of segments.  Level by level

* a node with many different children, none of them frequent, has variable segments: they become
  the wildcard ``*`` (frequent children of such a node stay literal);
* literal siblings that are statistically similar to the rest of their node (their rates of blocked
  pages and of pages that end there differ neither by a two-proportion test nor by much) are merged
  into the branch ``+``.  A branch without labelled pages is no evidence: it is like others without
  any, but never like labelled ones, and so takes no verdict from another branch's rule.

The leaves are templates.  Pages decided by a rule are the labelled ones; a template is rejected if
its smoothed share of blocked pages among the labelled is high and enough of its pages are labelled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, table

#: Verdict and rule, as given for the query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node has variable segments from so many different children on, if that is this share of its paths.
VARIABLE_FROM, VARIABLE_SHARE = 8, 0.05
#: A child with this share of its node's pages keeps its name.
FREQUENT = 0.1
#: Two branches differ if their rates do by so many standard errors and by so much.
Z, APART = 2.58, 0.1
#: Weight of the even prior, and what a template's pages must show to be rejected.
PRIOR, REJECT_AT, LABELLED_SHARE = 2.0, 0.8, 0.25
#: So many paths of one template meet what is known of it together; those of a larger one are dealt over several shares.
PATHS_TOGETHER = 1000


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lowered) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its verdict, both null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _differ(a: F.Column, n: F.Column, b: F.Column, m: F.Column) -> F.Column:
    """Whether the rates ``a / n`` and ``b / m`` differ; without observations nothing does."""
    pooled = (a + b) / (n + m)
    gap = F.abs(a / n - b / m)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return F.when((n > 0) & (m > 0), (gap > APART) & (gap > Z * error)).otherwise(False)


def _meet(many: DataFrame, one: DataFrame, by: str) -> DataFrame:
    """``many`` joined to its row of ``one`` by host and template, dealt by ``by`` into the shares that ``crowd`` asks for.

    ``crowd`` is the same in all rows of a template.  ``one`` is repeated for each share, a row for
    each :data:`PATHS_TOGETHER` paths more at most.
    """
    shares = F.ceil(F.col("crowd") / PATHS_TOGETHER).cast("int")
    dealt = many.withColumn("share", F.pmod(F.xxhash64(by), shares).cast("int"))
    spread = one.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("crowd")
    return dealt.join(spread, ["host", "template", "share"]).drop("share")


def templates(paths: DataFrame) -> DataFrame:
    """``host``, ``path``, ``template``, ``crowd`` for distinct ``host``, ``path`` with ``n``, ``allowed``, ``blocked``.

    A path without segments has the template ``/``.  Every segment is judged, however deep; a path
    alone in its node takes the rest of its segments as they are, as level by level it would.
    ``crowd`` bounds the number of paths of a template (1 for the roots of hosts, which are not counted).
    """
    # Segments that look like wildcards are literal and get a backslash before them.
    parts = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"^\\*[*+]$"), F.concat(F.lit("\\"), s)).otherwise(s))
    start = paths.select("host", "path", "n", "allowed", "blocked", parts.alias("left"), F.lit("").alias("template"), F.lit(1).cast("long").alias("crowd"))
    tree = materialise(start, "url-tree")
    more = F.size("left") > 0
    done = [tree.filter(~more).withColumn("template", F.lit("/"))]
    at = tree.filter(more)
    while not at.isEmpty():
        at = at.withColumn("segment", F.element_at("left", 1))
        ends = F.when(F.size("left") == 1, F.col("n")).otherwise(0)
        child = at.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.sum(ends).alias("e"), F.count("*").alias("p"), F.max("crowd").alias("crowd"))
        sums = [F.sum(c).alias(f"all_{c}") for c in ("n", "a", "b", "e", "p")]
        node = child.groupBy("host", "template").agg(F.count("*").alias("k"), *sums, F.max("crowd").alias("crowd"))
        known = _meet(child, node, "segment")
        variable = (F.col("k") >= VARIABLE_FROM) & (F.col("k") >= VARIABLE_SHARE * F.col("all_p")) & (F.col("n") < FREQUENT * F.col("all_n"))
        other = {c: F.col(f"all_{c}") - F.col(c) for c in ("n", "a", "b", "e")}
        labels, others = F.col("a") + F.col("b"), other["a"] + other["b"]
        same = (other["n"] > 0) & ((labels > 0) == (others > 0)) & ~_differ(F.col("b"), labels, other["b"], others) & ~_differ(F.col("e"), F.col("n"), other["e"], other["n"])
        name = F.when(variable, "*").when(same, "+").otherwise(F.col("segment"))
        # Of a node one template at most is ``*`` and one ``+``; they hold no more than all of its paths.
        crowd = F.when(variable | same, F.col("all_p")).otherwise(F.col("p"))
        named = known.select("host", "template", "segment", name.alias("name"), (F.col("all_p") == 1).alias("alone"), crowd.alias("next"))
        template = F.concat("template", F.lit("/"), F.when(F.col("alone"), F.array_join("left", "/")).otherwise(F.col("name")))
        left = F.when(F.col("alone"), F.slice("left", 1, 0)).otherwise(F.expr("slice(left, 2, size(left))"))
        moved = at.join(named, ["host", "template", "segment"]).select("host", "path", "n", "allowed", "blocked", left.alias("left"), template.alias("template"), F.col("next").alias("crowd"))
        tree = materialise(moved, "url-tree")
        done.append(tree.filter(~more))
        at = tree.filter(more)
    return reduce(DataFrame.unionByName, done).select("host", "path", "template", "n", "allowed", "blocked", "crowd")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` per row of ``pages``.

    ``purity`` is the template's smoothed share of blocked pages among its labelled ones.  URLs that
    are null or have no ``://`` form the host ``''``; null ids are like any other.  Repeated rows are
    returned each and count each.  Paths are judged whole, however long.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    found = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    found = found.withColumn("rule", rule).withColumn("said", said)
    paths = found.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"))
    tree = templates(paths)
    sums = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.max("crowd").alias("crowd"))
    labelled = F.col("a") + F.col("b")
    purity = (F.col("b") + PRIOR / 2) / (labelled + PRIOR)
    bad = (purity >= REJECT_AT) & (labelled >= LABELLED_SHARE * F.col("n"))
    judged = _meet(tree.select("host", "path", "template", "crowd"), sums.select("host", "template", "crowd", purity.alias("purity"), bad.alias("bad")), "path")
    verdict = F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow"))
    return found.join(judged, ["host", "path"]).select("id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
