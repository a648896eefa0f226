"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words.  A document of relative weight ``w`` is wanted
``e = min(cap, w * c)`` times, ``c`` being the source's rate: ``floor(e)`` whole copies are certain
and the fraction ``p = e - floor(e)`` is an inclusion probability.  Documents are ranked by

    q = (u / (1 - u)) / (p / (1 - p))

with ``u`` uniform, a hash of the row and the seed, and the lowest ranks are taken until their
words fill what the certain copies leave of the target (Pareto order sampling, with size counted in
words).  The gap before the first document that no longer fits is filled by one of a like size; that
one document of a source is chosen outside the order.

Rows that are equal in id, text and source are told apart by a number among them, so that they are
drawn one by one; which of them is number one does not matter, as they are equal.

No source is gathered in one task to be ranked.  ``q / (1 + q)`` lies in [0, 1); words are summed
in 4096 bins of it, the bin that crosses the target is binned again, and only the few rows of the
last bin are ranked.  What returns to the rows is one threshold per source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, table, words_in

BINS = 4096
SEED = 20


def targets(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """``target`` for each row of ``source``, ``source_size``: shares of the total of all sizes.

    Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...  A source's target stops at
    ``cap`` times its size and the excess is shared again by weight until none is above.  The end of
    that is ``min(cap * size, weight * level)`` with one common ``level``: with the sources in order
    of ``cap * size / weight``, those before the level are full and the level follows from a running
    sum.  One row per source goes through these windows, however many rows the source has.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    fill = Window.orderBy("full_at", "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("full_at", "source_no")
    weighed = totals.withColumn("source_no", F.row_number().over(place)).withColumn("share", ((F.col("source_no") - 1) % 3 + 1).cast("double"))
    most = weighed.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("share"))
    summed = (
        most.withColumn("filled", F.sum("most").over(fill) - F.col("most"))
        .withColumn("open_share", F.sum("share").over(everything) - F.sum("share").over(fill) + F.col("share"))
        .withColumn("all_size", F.sum("source_size").over(everything))
    )
    levels = summed.withColumn("level", (F.col("all_size") - F.col("filled")) / F.col("open_share"))
    return levels.withColumn("level", F.first(F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True).over(everything)).select(
        "source", "source_no", "source_size", F.coalesce(F.least("most", F.col("share") * F.col("level")), "most").alias("target")
    )


def _crossing(sums: DataFrame, need: str) -> DataFrame:
    """Of each source the bin that reaches the words needed, and the words before it."""
    by = Window.partitionBy("source_no").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("upto", F.sum("words").over(by))
    hit = run.filter(F.col("upto") >= F.col(need)).groupBy("source_no").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("x"))
    return hit.select("source_no", F.col("x.bin").alias("bin"), F.col("x.before").alias("before"))


Weight = F.Column | Callable[[F.Column], F.Column] | None


def longer_more(size: F.Column) -> F.Column:
    """Weights of ``op4_mixing``: ``1 + ln(size)``, so that a document of 1000 words is wanted some eight times as often as one of a single word."""
    return 1 + F.log(F.greatest(size, F.lit(1)))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Weight, seed: int, carry: list[F.Column]) -> DataFrame:
    """A table of ``carry``, ``source``, ``size``, ``w`` and a ``row_key`` that is another for each of several equal rows."""
    size = words_in(F.col(text_col))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col))
    given = [] if weight is None or callable(weight) else [weight.cast("double").alias("w")]
    rows = docs.select(*carry, F.col(source_col).alias("source"), size.alias("size"), key.alias("row_key"), *given)
    if not given:
        rows = rows.withColumn("w", F.lit(1.0) if weight is None else weight(F.col("size")).cast("double"))
    rows = rows.withColumn("w", F.when(F.isnan("w"), 0.0).otherwise(F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))))
    rows = materialise(rows.withColumn("part", F.spark_partition_id()).withColumn("serial", F.monotonically_increasing_id()), "mix-rows")
    # Numbers among equal rows in two levels, so that no group of copies meets in one task.
    many = materialise(rows.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key"), "mix-repeats")
    if many.isEmpty():
        return rows.drop("part", "serial")
    copies = rows.select("row_key", "part", "serial").join(many, "row_key", "left_semi")
    before = Window.partitionBy("row_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = copies.groupBy("row_key", "part").agg(F.count("*").alias("n")).select("row_key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = copies.withColumn("rank", F.row_number().over(Window.partitionBy("row_key", "part").orderBy("serial")))
    numbered = ranked.join(parts, ["row_key", "part"]).select("serial", (F.col("rank") + F.col("before") - 1).alias("number"))
    told = rows.join(materialise(numbered, "mix-numbers"), "serial", "left")
    return materialise(told.withColumn("row_key", F.when(F.col("number") > 0, F.xxhash64("row_key", "number")).otherwise(F.col("row_key"))).drop("part", "serial", "number"), "mix-rows")


def _rates(sized: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """``wanted`` with the ``rate`` at which the documents' expected words add up to the target.

    Documents that reach the cap are taken out and the rate of the others is raised, until no more
    reach it.  Each pass sums one row per source and weight, not the documents.
    """
    grouped = materialise(sized.filter("size > 0 and w > 0").groupBy("source", "w").agg(F.sum("size").alias("size")), "mix-weights")
    rates, capped = materialise(wanted.withColumn("rate", F.lit(0.0)), "mix-rates"), None
    while True:
        known = grouped.join(rates, grouped["source"].eqNullSafe(rates["source"])).drop(rates["source"])
        full = F.col("w") * F.col("rate") >= cap * (1 - 1e-12)
        sums = known.groupBy("source_no").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("w") * F.col("size"))).alias("open"),
            F.count_if(full).alias("n_full"),
            F.min("w").alias("least"),
        )
        left = F.greatest(F.col("target") - cap * F.col("full"), F.lit(0.0))
        # Where all documents of a source are at the cap, any rate that keeps them there will do.
        rate = F.when(F.col("open") > 0, left / F.col("open")).otherwise(cap / F.col("least") * (1 + 1e-9))
        rates = materialise(wanted.join(sums, "source_no", "left").select(*wanted.columns, F.coalesce("n_full", F.lit(0)).alias("n_full"), F.coalesce(rate, F.lit(0.0)).alias("rate")), "mix-rates")
        then = rates.agg(F.sum("n_full")).first()[0]
        rates = rates.drop("n_full")
        if then == capped:
            return rates
        capped = then


def _spots(sized: DataFrame, rates: DataFrame, cap: float) -> DataFrame:
    """Rows with their source's figures, ``certain`` copies and ``spot``, the rank within the source."""
    known = sized.join(rates, sized["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    times = F.least(F.lit(cap), F.col("w") * F.col("rate"))
    known = known.withColumn("certain", F.floor(times)).withColumn("p", times - F.floor(times))
    u = (F.pmod(F.col("row_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # A document at its cap has no copy left to take; one whose wish is whole comes last.
    last = 1 - 2.0**-20 + u * 2.0**-21
    spot = F.when((F.col("certain") + 1 <= cap) & (F.col("size") > 0), F.coalesce(odds / (1 + odds), last))
    return known.withColumn("spot", spot).drop("p")


def thresholds(sized: DataFrame, cap: float = 3.0) -> DataFrame:
    """One row per source: its figures, its rate, and the rank up to which documents are taken.

    ``sized`` is a table (it is read several times) of ``source``, ``size``, ``row_key``, ``w``.
    """
    wanted = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap), "mix-targets")
    rates = _rates(sized, wanted, cap)
    known = _spots(sized, rates, cap)
    base = known.groupBy("source_no").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    # Where less than half a word is missing nothing is drawn.
    need = F.col("target") - F.col("sure")
    base = materialise(base.select("source_no", F.when(need < 0.5, 0.0).otherwise(need).alias("need")), "mix-need")
    ranked = known.filter("spot is not null").select("source_no", "size", "spot", "row_key", F.floor(F.col("spot") * BINS).alias("coarse"), (F.floor(F.col("spot") * BINS * BINS) % BINS).alias("fine"))
    first = ranked.groupBy("source_no", F.col("coarse").alias("bin")).agg(F.sum("size").alias("words")).join(base.filter("need > 0"), "source_no")
    one = materialise(_crossing(first, "need").select("source_no", F.col("bin").alias("bin1"), F.col("before").alias("before1")), "mix-bin")
    within = ranked.join(one.join(base, "source_no"), "source_no").filter("coarse = bin1")
    second = within.groupBy("source_no", F.col("fine").alias("bin"), "before1", "need").agg(F.sum("size").alias("words")).withColumn("rest", F.col("need") - F.col("before1"))
    two = _crossing(second, "rest").select("source_no", F.col("bin").alias("bin2"), F.col("before").alias("before2"))
    last = within.join(two, "source_no").filter("fine = bin2").withColumn("rest", F.col("need") - F.col("before1") - F.col("before2"))
    by = Window.partitionBy("source_no").orderBy("spot", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = last.withColumn("upto", F.sum("size").over(by))
    fits = F.col("upto") <= F.col("rest")
    ends = run.groupBy("source_no").agg(F.max(F.when(fits, F.struct("spot", "row_key"))).alias("end"), (F.first("rest") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("gap"))
    # Where no row of the last bin is taken, the bin's lower edge alone is the threshold.
    cut = one.join(two, "source_no").join(ends, "source_no").select("source_no", (F.col("bin1") + F.col("bin2") / BINS).alias("edge"), "end", "gap")
    cut = materialise(cut, "mix-cut")
    # The words still missing are fewer than the next document has; of those after the threshold the
    # one of the nearest size fills them, if that is nearer than leaving them out.
    after = ranked.join(cut, "source_no").filter(~_within("spot", "row_key"))
    off = F.abs(F.col("size") - F.col("gap"))
    filler = after.filter(off < F.col("gap")).groupBy("source_no").agg(F.min_by("row_key", F.struct(off, "spot", "row_key")).alias("filler"))
    return materialise(rates.join(base, "source_no", "left").join(cut, "source_no", "left").join(filler, "source_no", "left"), "mix-thresholds")


def _within(spot: str, row_key: str) -> F.Column:
    return (F.col(spot) * BINS < F.col("edge")) | F.coalesce(F.struct(F.col(spot), F.col(row_key)) <= F.col("end"), F.lit(False))


def _taken(rows: DataFrame, cut: DataFrame, cap: float) -> DataFrame:
    """``rows`` with ``copies``; nothing but the few rows of ``cut`` is joined to them."""
    placed = _spots(rows, cut, cap)
    # A source without a crossing needs all the words that are left.
    ranked = F.col("edge").isNull() | _within("spot", "row_key") | F.coalesce(F.col("row_key") == F.col("filler"), F.lit(False))
    extra = F.col("spot").isNotNull() & (F.col("need") > 0) & ranked
    copies = F.when(F.col("size") > 0, F.col("certain") + F.when(extra, 1).otherwise(0)).otherwise(0)
    return placed.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Weight = None, cap: float = 3.0, seed: int = SEED) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` per row of ``docs``.

    ``weight`` is a document's relative wish to be taken within its source: a column of ``docs``, or
    a function of the column of sizes (default: equal; null, NaN and negative count as 0, and such
    documents are taken only if the others cannot fill the target).  A document's ``copies`` never
    exceed ``cap``; null and empty texts, and those without words, have none.  A null source is a
    source; null ids are like any other.  The result is a function of the rows' contents and
    ``seed``, so reruns agree; of equal rows some may be taken more often than others.  Other columns
    are ignored, whatever their names.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sized = _rows(docs, id_col, text_col, source_col, weight, seed, [F.col(id_col).alias("id")])
    found = _taken(sized, thresholds(sized, cap), cap)
    return found.select("id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Weight = None, cap: float = 3.0, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; like :func:`mix` in all else.

    The texts are written once with their sizes and stay where they are: rows meet the thresholds of
    their source, not a table of choices.
    """
    prepare(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, source_col, weight, seed, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])
    cut = thresholds(rows.select("source", "size", "row_key", "w"), cap)
    taken = _taken(rows, cut, cap).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), weight=longer_more)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")
