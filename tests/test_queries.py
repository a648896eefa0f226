from __future__ import annotations

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, int | float | np.floating | np.integer) and not isinstance(v, bool) else v for v in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.astype(object).where(got.notna(), None)) == _rows(want.astype(object).where(want.notna(), None))


def test_flagship(spark):
    assert entry.entry(spark).filter("refused is null and price > 0").count() == 200


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _both(spark, name, folder, table):
    got = entry.queries()[name](spark, str(folder)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert _rows(got.astype(object).where(got.notna(), None)) == _rows(want.astype(object).where(want.notna(), None))
    return got


def test_whole_texts_are_cleaned(spark, tmp_path):
    head = "word " * 80
    ends = ["<i>a</i> &quot;b&quot;", "<i>a</i>  &lt;c&gt;\n &copy;&middot;", "d", "e"]
    spark.createDataFrame([*[(i, head + t) for i, t in enumerate(ends)], (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = _both(spark, "clean_text_whole", tmp_path, "documents").set_index("doc_id").cleaned
    assert got[got.notna()].nunique() == 4 and len(got) == 5  # the texts differ from character 400 on only
    plain = [f'{head}a "b"', f"{head}a <c> ©·", f"{head}d", f"{head}e"]
    assert [got[i] for i in range(4)] == [hashlib.md5(" ".join(f"{t} & more".split()).encode()).hexdigest() for t in plain]


def test_articles_are_divided_by_every_axis(spark, tmp_path):
    # Page 1 has three axes; article s1 has a choice on all, s2 lacks the third one.
    rows = [(1, n, 1, "A") for n in (1, 2, 3)] + [(1, n, 2, "R") for n in (1, 2)] + [(2, 7, 3, "N")]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = _both(spark, "sku_set_all_axes", tmp_path, "lineitem")
    assert sorted(zip(got.page_id, got.sku, got.options, strict=True)) == [(1, "s1", "a1=A,a2=A,a3=A"), (2, "s3", "a7=N")]


@pytest.mark.parametrize("name", ["page_title", "page_heading", "page_profile"])
def test_references_cut_in_titles_and_headings_stay_as_written(spark, tmp_path, name):
    pages = [(i, f"<html><head><title>Bolts &amp; {t}</title></head><body><h1>Nuts &amp;&amp; {t}</h1><p>x</p></body></html>") for i, t in enumerate(["x&amp", "AT&T", "y&quo", "&amp;&amp;&amp", "&quot;z&quot;"])]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(_both(spark, name, tmp_path, "pages")) == 5


def test_scores_of_all_flags_are_those_of_the_sql(spark, tmp_path):
    # By remainders of 2, 3, 5, 7, 11, 13, 17 and 19 any of 256 sets of flags.
    primes = (2, 3, 5, 7, 11, 13, 17, 19)
    whole = math.prod(primes)
    one = {p: (whole // p) * pow(whole // p, -1, p) for p in primes}
    ids = [(sum(one[p] for i, p in enumerate(primes) if s >> i & 1) % whole,) for s in range(256)]
    spark.createDataFrame(ids, "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(_both(spark, "warnings_confidence_refusal", tmp_path, "documents")) == 256


def test_numbers_beside_rows_of_signs_sell_nothing(spark, tmp_path):
    texts = ["Call +1 (678) 555-5272$$$ soon.", "oneant$$$ 37 %%% of", "At 10.1.2.3$$$ it is.", "Plain."]
    pages = [(i, f'<html><head><meta charset="utf-8"><title>Thing {i}</title></head><body><article><h1>Thing {i}</h1><p>{t}</p></article></body></html>') for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(_both(spark, "page_records", tmp_path, "pages")) == 4


def test_every_page_says_where_name_and_price_came_from(spark, db):
    got = entry.queries()["shop_provenance"](spark, SF).toPandas()
    pages = {r[0] for r in db.execute("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)").fetchall()}
    assert {(r.page_id, r.field) for r in got.itertuples()} == {(p, f) for p in pages for f in ("name", "price")}
    offers = got[(got.page_id % 12 == 11) & (got.field == "price")].origin
    assert len(offers) and offers.str.fullmatch(r"json:offers\.offers\[\d+\]\.price").all() and offers.nunique() > 1
