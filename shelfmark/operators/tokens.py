"""Which of many tokens occur in which of many addresses, without comparing each with each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many tokens make one automaton, and so many addresses go through a copy of it in one task.
TOKENS_TOGETHER, URLS_TOGETHER = 100_000, 200_000


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in order, each with its tokens before its addresses."""
    import ahocorasick

    group, automaton, ready = None, None, False
    for batch in batches:
        ids, tokens = [], []
        for block, share, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (block, share) != group:
                group, automaton, ready = (block, share), ahocorasick.Automaton(), False
            if key is None:
                automaton.add_word(text, text)
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            found = {t for _, t in automaton.iter(text)} if len(automaton) else ()
            ids.extend([key] * len(found))
            tokens.extend(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string())], names=["row", "token"])


def tokens_in_urls(pages: DataFrame, tokens: DataFrame, id_col: str = "page_id", url_col: str = "url", token_col: str = "token") -> DataFrame:
    """``page_id``, ``token`` for every token that occurs in a page's address, as :meth:`Column.contains` would say.

    The tokens are dealt by hash over blocks of bounded size, and each block over as many shares as
    the addresses need; an address meets one automaton for each block, which finds all tokens of the
    block in one pass over it.  Null and empty tokens and null addresses match nothing; repeated
    rows of pages are returned each, repeated tokens once.
    """
    wanted = tokens.select(F.col(token_col).cast("string").alias("text")).filter("text <> ''").distinct()
    n_tokens, n_pages = wanted.count(), pages.count()
    blocks, shares = max(1, -(-n_tokens // TOKENS_TOGETHER)), max(1, -(-n_pages // URLS_TOGETHER), pages.sparkSession.sparkContext.defaultParallelism if n_pages > 10_000 else 1)
    no_key = F.lit(None).cast("long")
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), no_key.alias("row"), "text")
    named = pages.select(F.col(id_col).cast("long").alias("row"), F.col(url_col).cast("string").alias("text")).filter("text is not null and row is not null")
    sent = named.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("row", "text"), F.lit(shares)).cast("int").alias("share"), "row", "text")
    rows = dealt.unionByName(sent).repartition("block", "share").sortWithinPartitions("block", "share", F.col("row").asc_nulls_first())
    return rows.mapInArrow(_match, "row long, token string").withColumnRenamed("row", id_col)
