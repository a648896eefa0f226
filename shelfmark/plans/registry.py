"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from shelfmark.plans import queries_catalog, queries_facets, queries_match, queries_pages, queries_shop, queries_text, queries_time  # noqa: F401  (registers the queries)
from shelfmark.plans.queries_text import QUERIES, SQL
