"""Category retrieval: sparse TF-IDF over the paths of a taxonomy, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.text import collapse, first_sentence, strip

SHORTLIST, BRANCHES, EXPANDED = 20, 2, 45
MOST_QUERY, MOST_SENTENCE = 320, 120
#: Characters of all paths up to which a taxonomy's vectors are broadcast: 1.5 entries of some 40 bytes a character at most.
BROADCAST_CHARS = 2_000_000


def terms(text: Column) -> Column:
    """Words of a-z and all runs of four characters, in lower case, repeats included."""
    low = F.lower(text)
    grams = F.when(F.length(low) >= 4, F.transform(F.sequence(F.lit(1), F.length(low) - 3), lambda i: F.substr(low, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)), grams)


def _counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(taxonomy: DataFrame) -> DataFrame:
    """``term``, ``idf`` = ln(n / (1 + documents with it)), with ``unseen`` = ln(n) beside it."""
    n = taxonomy.agg(F.count("*").cast("double").alias("n"))
    df = _counted(taxonomy, "ord", "path").groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"), F.log("n").alias("unseen"))


def vectors(docs: DataFrame, key: str, text: str, weights: DataFrame, unseen: DataFrame) -> DataFrame:
    """``key``, ``term``, ``w``: (1 + ln tf) * idf at unit length; unseen terms weigh ln(n)."""
    raw = _counted(docs, key, text).join(weights.select("term", "idf"), "term", "left").crossJoin(F.broadcast(unseen))
    raw = raw.select(key, "term", ((1 + F.log("tf")) * F.coalesce("idf", "unseen")).alias("w"))
    # A window and no join: terms are then counted once.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.withColumn("norm", norm).select(key, "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def root_of(path: Column) -> Column:
    return strip(F.split_part(path, F.lit(">"), F.lit(1)))


def shortlist(queries: DataFrame, taxonomy: DataFrame, key: str = "query_id", text: str = "query", roots: str | None = None, k: int = SHORTLIST) -> DataFrame:
    """``key``, ``path``, ``ord``, ``score``, ``rank``: the ``k`` nearest paths; ties go to the later path.

    ``taxonomy`` has ``path`` and ``ord``.  ``roots``, a column of root names, restricts the paths;
    roots that match nothing restrict nothing.  Only paths that share a term are scored, so that
    queries meet postings and not the whole taxonomy.  A taxonomy of :data:`BROADCAST_CHARS` at most
    (its characters are summed first) goes to the queries, which are then shuffled by ``key`` alone
    and never by term, where common terms would be hot; a larger one is joined by term.
    """
    # One row; the number of paths.
    unseen = taxonomy.agg(F.log(F.count("*").cast("double")).alias("unseen"))
    chars = taxonomy.agg(F.sum(F.length("path"))).first()[0] or 0
    sent = F.broadcast if chars <= BROADCAST_CHARS else lambda df: df
    weights = idf(taxonomy)
    paths = vectors(taxonomy, "ord", "path", weights, unseen).withColumnRenamed("w", "pw")
    asked = vectors(queries, key, text, sent(weights), unseen)
    scored = asked.join(sent(paths), "term").groupBy(key, "ord").agg(F.sum(F.col("w") * F.col("pw")).alias("score"))
    named = scored.join(sent(taxonomy.select("ord", "path")), "ord")
    if roots:
        wanted = queries.select(key, F.transform(roots, lambda r: F.lower(strip(r))).alias("wanted"))
        named = named.join(wanted, key).withColumn("fits", F.coalesce(F.array_contains("wanted", F.lower(root_of(F.col("path")))), F.lit(False)))
        named = named.withColumn("any", F.max("fits").over(Window.partitionBy(key))).filter("fits or not any").drop("wanted", "fits", "any")
    # Sums of doubles in another order differ in the last digits; equal vectors must still tie.
    order = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), F.col("ord").desc())
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "path", "ord", "score", "rank")


def lexical_only(queries: DataFrame, taxonomy: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    return shortlist(queries, taxonomy, key, text, k=1).select(key, F.col("path").alias("category"))


def _prefix(path: Column, depth: int) -> Column:
    parts = F.transform(F.split(path, ">"), strip)
    return F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, 1, depth), " > "))


def expand(listed: DataFrame, taxonomy: DataFrame, key: str = "query_id", branches: int = BRANCHES, cap: int = EXPANDED) -> DataFrame:
    """``key``, ``path``, ``place``: the shortlist, then the children of the branches it votes for, interleaved.

    A path of rank ``r`` gives 1 / r to its prefixes of depth two and three; the first seen wins ties.
    """
    prefixes = F.array(*[F.struct(F.lit(d).alias("d"), _prefix(F.col("path"), d).alias("prefix")) for d in (2, 3)])
    votes = listed.select(key, "rank", F.inline(prefixes)).filter("prefix is not null").groupBy(key, "prefix").agg(F.sum(1.0 / F.col("rank")).alias("v"), F.min(F.struct("rank", "d")).alias("seen"))
    top = votes.withColumn("branch", F.row_number().over(Window.partitionBy(key).orderBy(F.round("v", 9).desc(), "seen"))).filter(F.col("branch") <= branches)
    parts = F.transform(F.split("path", ">"), strip)
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > "))
    kids = taxonomy.select(parent.alias("prefix"), "path", "ord").filter("prefix is not null").unionByName(taxonomy.select(F.col("path").alias("prefix"), "path", F.lit(-1).alias("ord")))
    opened = top.join(kids, "prefix").select(key, "branch", "path", "ord").join(listed.select(key, "path"), [key, "path"], "left_anti")
    first = Window.partitionBy(key, "branch").orderBy("ord")
    turns = opened.withColumn("i", F.row_number().over(first))
    # A path in both branches appears where its turn comes first, and again: it is not told apart.
    rows = turns.select(key, "path", (F.lit(1_000_000) + F.col("i") * 1000 + F.col("branch")).alias("o")).unionByName(listed.select(key, "path", F.col("rank").alias("o")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("o"))).filter(F.col("place") <= cap).select(key, "path", "place")


def coerce(answers: DataFrame, taxonomy: DataFrame, listed: DataFrame | None = None, key: str = "query_id", answer: str = "answer") -> DataFrame:
    """``key``, ``category``, ``how``: any answer as a path of the taxonomy.

    In order: as it is, with separators spaced, in any case, the listed (else any) path that shares
    most words, and without an answer the first listed (else first) path.
    """
    given = answers.select(key, F.coalesce(strip(F.col(answer)), F.lit("")).alias("a"))
    spaced = F.regexp_replace("a", rf"[{P.WS}]*>[{P.WS}]*", " > ")
    given = given.withColumn("spaced", spaced).withColumn("low", F.lower("spaced"))
    valid = taxonomy.select(F.col("path").alias("exact"))
    respaced = taxonomy.select(F.col("path").alias("respaced"))
    recased = taxonomy.groupBy(F.lower("path").alias("low")).agg(F.min_by("path", "ord").alias("recased"))
    known = given.join(valid, given["a"] == valid["exact"], "left").join(respaced, F.col("spaced") == F.col("respaced"), "left").join(recased, "low", "left")
    pool = taxonomy.select("path", F.col("ord").alias("o"))
    open_ = known.filter("exact is null and respaced is null and recased is null").select(key, "a", "low")
    if listed is not None:
        with_list = open_.join(listed.select(key, "path", F.col("rank").alias("o")), key)
        without = open_.join(listed.select(key).distinct(), key, "left_anti")
    else:
        with_list, without = None, open_
    # Answers without a shortlist meet paths through shared words only.
    words = F.array_distinct(F.regexp_extract_all(F.col("low"), F.lit("([a-z]+)"), F.lit(1)))
    met = without.select(key, "a", F.explode(words).alias("word")).join(pool.select("path", "o", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("path"), F.lit("([a-z]+)"), F.lit(1)))).alias("word")), "word")
    shared = met.groupBy(key, "path", "o").agg(F.count("*").alias("s"))
    guesses = shared.groupBy(key).agg(F.min_by("path", F.struct((-F.col("s")).alias("s"), "o")).alias("guessed"))
    if with_list is not None:
        common = F.size(F.array_intersect(words, F.regexp_extract_all(F.lower("path"), F.lit("([a-z]+)"), F.lit(1))))
        of_list = with_list.filter("a <> ''").groupBy(key).agg(F.min_by("path", F.struct((-common).alias("s"), "o")).alias("guessed"))
        guesses = guesses.unionByName(of_list)
        heads = listed.groupBy(key).agg(F.min_by("path", "rank").alias("head"))
    else:
        heads = answers.select(key).limit(0).withColumn("head", F.lit(None).cast("string"))
    first = taxonomy.agg(F.min_by("path", "ord").alias("first_path"))
    full = known.join(guesses, key, "left").join(heads, key, "left").crossJoin(F.broadcast(first))
    guessed = F.when(F.col("a") != "", F.coalesce("guessed", "head", "first_path"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("respaced").isNotNull(), "respaced").when(F.col("recased").isNotNull(), "recased").when(F.col("a") != "", "guessed").otherwise("fallback")
    return full.select(key, F.coalesce("exact", "respaced", "recased", guessed, "head", "first_path").alias("category"), how.alias("how"))


def valid_categories(rows: DataFrame, taxonomy: DataFrame, column: str = "category") -> DataFrame:
    """The rows whose category is in the taxonomy."""
    return rows.join(taxonomy.select(F.col("path").alias(column)), column, "left_semi")


def retrieval_query(name: Column, brand: Column, trail: Column, description: Column) -> Column:
    """What the retriever sees: the trail, the name and the first sentence, without the brand."""
    kept = F.filter(trail, lambda c: (c != "") & ~strip(c).rlike(P.QUERY_NOISE) & (F.length(c) < 50))
    last = F.lower(strip(F.try_element_at(kept, F.lit(-1))))
    repeats = F.coalesce(F.contains(F.lower(strip(name)), last), F.lit(False))
    crumbs = F.when(repeats, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    said = F.nullif(F.array_join(crumbs, " "), F.lit(""))
    whole = F.concat_ws(" ", said, F.nullif(name, F.lit("")), F.substring(first_sentence(F.nullif(description, F.lit(""))), 1, MOST_SENTENCE))
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(brand, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    bare = F.when(F.coalesce(brand, F.lit("")) != "", F.regexp_replace(whole, quoted, F.lit(" "))).otherwise(whole)
    return F.substring(collapse(bare), 1, MOST_QUERY)
