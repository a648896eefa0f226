from __future__ import annotations

import duckdb
import pytest

from tests import sample_queries
from tests.test_queries import SF, _rows


@pytest.mark.parametrize("name", sorted(sample_queries.QUERIES))
def test_sample_pages_give_the_rows_written_for_them(spark, name):
    got = sample_queries.QUERIES[name](spark, SF).toPandas()
    want = duckdb.execute(sample_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.astype(object).where(got.notna(), None)) == _rows(want.astype(object).where(want.notna(), None))
