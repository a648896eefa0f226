from __future__ import annotations

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import fim

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(key, text):
    """n, form, prefix and middle lengths, output: as the rule reads."""
    text = text or ""
    units = TOKEN.findall(text)
    hashed = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hashed[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=400, unique=True), st.integers(0, 100_000))
def test_elias_fano_lists_give_back_each_number(values, more):
    values = np.array(sorted(values))
    packed = fim.EliasFano(values, int(values[-1]) + more)
    assert [packed.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_lists_are_small():
    ends = np.cumsum(np.random.default_rng(7).integers(2, 12, 200_000))
    packed = fim.EliasFano(ends, int(ends[-1]))
    assert packed.size * 8 < 6 * len(ends)
    assert [packed.select(i) for i in range(0, 200_000, 997)] == ends[::997].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0aé漢😀<P>"), max_size=60))
def test_token_ends_are_those_of_the_pattern(text):
    ends = np.cumsum([0, *(len(u.encode()) for u in TOKEN.findall(text))])[1:].tolist()
    assert fim.token_ends(text.encode()).tolist() == ends
    at, fim.BYTES_AT_ONCE = fim.BYTES_AT_ONCE, 3
    try:
        assert fim.token_ends(text.encode()).tolist() == ends
    finally:
        fim.BYTES_AT_ONCE = at


CASES = [
    (1, None), (2, ""), (None, "a b c d e f"), (None, "a b c d e f"), (3, " \n\t"), (4, "one"), (4, "one"), (5, "with <M> in it, and more"), (6, "é 漢字 😀 x" * 40),
    (7, "long " * 300_000 + "end"), (8, "same words again"), (9, "same words again"), (10, "same words again"), (11, "  led by blanks and trailed  "), (-5, "below nought is an id too"),
]


def test_every_case_is_cut_as_the_rule_reads(spark):
    rows = [(k, t, "x", 1) for k, t in CASES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, name int").repartition(4)
    got = fim.fill_in_middle(docs).collect()
    want = [(k, *plainly(k, t)) for k, t in CASES]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_hot_texts_are_split_and_each_copy_has_its_own_cut(spark):
    docs = spark.range(3000, numPartitions=4).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the hot text of a third of all rows', concat('text ', id % 50, ' of few copies')) AS text")
    got = {r.id: tuple(r)[1:] for r in fim.fill_in_middle(docs).collect()}
    assert got == {r.doc_id: plainly(r.doc_id, r.text) for r in docs.collect()}
    sent = docs.mapInArrow(fim._send, "name binary, share long, member boolean, id long, data binary").collect()
    assert len({r.share for r in sent if r.member}) > 8 and max(sum(1 for r in sent if r.member and r.share == s) for s in {r.share for r in sent} - {0}) <= fim.TOGETHER
    texts = sum(not r.member for r in sent)
    assert texts <= 51 * 4 + 1000 // fim.TOGETHER


def test_outputs_are_read_back(spark):
    docs = spark.createDataFrame([(i, f"w{i} {'x ' * (i % 7)}<Q> y\n" * (i % 5)) for i in range(400)], "doc_id long, text string")
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form")))
    assert made.join(docs, made["id"] == docs["doc_id"]).filter("back = text").count() == 400


def test_query_gives_the_rows_of_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = fim.op12_fill_in_middle(spark, SF)
    assert os.path.exists(SF) and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, db.execute(fim.ORACLE_SQL).fetchall()))


def test_different_texts_of_one_name_are_an_error():
    from pyarrow import RecordBatch, array

    rows = [(b"n", 0, False, None, b"one"), (b"n", 0, False, None, b"two")]
    batch = RecordBatch.from_arrays([array(c, f.type) for c, f in zip(zip(*rows, strict=True), fim._SENT, strict=True)], schema=fim._SENT)
    with pytest.raises(ValueError, match="two texts"):
        list(fim._make(iter([batch])))
