"""Accounting of model calls from a log: the calls themselves are made elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P


def model_prices(spark: SparkSession) -> DataFrame:
    """``model``, ``input``, ``output``: dollars for a million tokens."""
    return spark.createDataFrame([(m, *p) for m, p in P.MODEL_PRICES.items()], "model string, input double, output double")


def call_costs(calls: DataFrame, prices: DataFrame, with_reasoning: bool = False) -> DataFrame:
    """``calls`` (``model``, ``tokens_in``, ``tokens_out``, ``tokens_reasoning``) with ``cost``; unknown models cost nothing."""
    billed = F.col("tokens_out") + (F.coalesce("tokens_reasoning", F.lit(0)) if with_reasoning else F.lit(0))
    cost = F.col("tokens_in") / 1e6 * F.coalesce("input", F.lit(0.0)) + billed / 1e6 * F.coalesce("output", F.lit(0.0))
    return calls.join(prices, "model", "left").withColumn("cost", cost).drop("input", "output")


def report(costed: DataFrame, products: int | Column) -> DataFrame:
    """One row: calls, tokens and dollars per product, and per 1 and 50 million products."""
    n = F.lit(products) if isinstance(products, int) else products
    per = F.sum("cost") / n
    return costed.agg(
        F.count("*").alias("calls"), (F.sum("tokens_in") / n).alias("tokens_in_per_product"), (F.sum("tokens_out") / n).alias("tokens_out_per_product"),
        per.alias("cost_per_product"), (per * 1e6).alias("cost_per_1m"), (per * 50e6).alias("cost_per_50m"),
    )


def is_transient(status: Column, error_name: Column) -> Column:
    """Whether a failed call is worth repeating: by its status if it has one, else by the error's name."""
    named = F.lit(False)
    for marker in P.TRANSIENT_NAMES:
        named = named | F.contains(F.lower(error_name), F.lit(marker))
    return F.when(status.isNotNull(), status.isin(*P.TRANSIENT_STATUS)).otherwise(F.coalesce(named, F.lit(False)))


def cascade_pick(answers: DataFrame, key: str = "page_id", attempt: str = "attempt") -> DataFrame:
    """Of each key the first answer that is not ``defective``, else the last one."""
    good = F.min(F.when(~F.col("defective"), F.col(attempt)))
    chosen = answers.groupBy(key).agg(F.coalesce(good, F.max(attempt)).alias(attempt))
    return answers.join(chosen, [key, attempt])


def is_defective(how: Column, n_features: Column, evidence_chars: Column, n_indices: Column, n_images: Column) -> Column:
    return how.isin("guessed", "fallback") | ((n_features == 0) & (evidence_chars > 4000)) | ((n_indices == 0) & (n_images > 1))


def retry_after(headers: Column) -> Column:
    """Seconds a provider asks to wait, from a map of response headers (names in any case); null if it says none or no number."""
    said = F.filter(F.map_entries(headers), lambda e: (F.lower(e["key"]) == "retry-after") & (e["value"] != ""))
    return F.try_element_at(said, F.lit(1))["value"].try_cast("double")


def escalations(answers: DataFrame, key: str = "page_id", attempt: str = "attempt") -> DataFrame:
    """:func:`cascade_pick` over answers judged here: expects the columns of :func:`is_defective` by name."""
    judged = answers.withColumn("defective", is_defective(F.col("how"), F.col("n_features"), F.col("evidence_chars"), F.col("n_indices"), F.col("n_images")))
    return cascade_pick(judged, key, attempt)
