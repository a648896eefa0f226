"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import cascade, embed, fim, search, warc
from shelfmark.llm.digest import op2_digest
from shelfmark.llm.html_main import op5_html_main
from shelfmark.llm.mixing import op4_mixing
from shelfmark.llm.packing import op6_packing
from shelfmark.llm.rollup import op9_token_counts
from shelfmark.llm.simhash import op3_simhash
from shelfmark.llm.toxicity import op10_toxicity
from shelfmark.llm.urltree import op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_digest": op2_digest,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_html_main": op5_html_main,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_embeddings": embed.op8_embeddings,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_quality_rules": cascade.op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE_SQL,
    "op8_embeddings": embed.ORACLE_SQL,
    "op11_ranked_search": search.ORACLE_SQL,
    "op12_fill_in_middle": fim.ORACLE_SQL,
    "op13_quality_rules": cascade.ORACLE_SQL,
}
