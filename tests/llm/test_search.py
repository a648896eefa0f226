from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import search as S

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(docs, items, k=10):
    """Rows (item, rank, doc, score) by going through all documents for every item; equal ids in any order."""
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    found = [(i, len(ts), Counter(ts)) for i, ts in found if ts]
    n, total = len(found), sum(x[1] for x in found)
    df = Counter(t for *_, c in found for t in c)
    rows = []
    for item, text in items:
        terms = {t for t in TERM.findall((text or "").translate(LOWER)) if t in df}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scored = [(sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * m * n // total))) for t in terms if t in c), i) for i, m, c in found]
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        rows += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return rows


def _corpus(n, seed=5):
    """Documents of four vocabularies, with ties, copies and repeated ids."""
    draw = random.Random(seed)
    words = [[f"{chr(97 + v)}{i}" for i in range(90)] for v in range(4)]
    docs = []
    for i in range(n):
        own = words[draw.randrange(4)]
        docs.append((i, " ".join(draw.choice(own if draw.random() < 0.9 else words[0]) for _ in range(draw.randrange(1, 60)))))
    copies = [(n + i, docs[3][1]) for i in range(n // 3)]
    return docs + copies


def test_results_are_those_of_a_plain_search_however_many_shards(spark):
    docs = _corpus(900) + [(5000, None), (5001, ""), (5002, "!? --"), (None, "a1 a2 Ä漢 a1"), (5003, "Ä漢 ÄB's"), (5004, "a1 " * 300), (5004, "b1 b2 b3"), (5004, "b1 b2 b3")]
    items = [(i, " ".join(docs[i * 7][1].split()[:12])) for i in range(40)] + [(100, None), (101, "nothing has this"), (102, "Ä漢 a1 A1"), (102, "b1, b2; b3"), (None, "c1 c2")]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, shard int").repartition(3)
    asked = spark.createDataFrame([(*q, "y") for q in items], "item_id long, text string, term string")
    want = sorted(map(str, plainly(docs, items)))
    told = []
    for shard_docs in (50, 100_000):
        index = S.build(table, shard_docs=shard_docs)
        got = S.search(index, asked, told=lambda a, b: told.append((a, b))).collect()
        assert sorted(map(str, map(tuple, got))) == want
    assert index.places.count() == len(docs) - 3
    assert told[0][0] < told[0][1] / 4  # with many shards, most are not visited at first
    # Every visit counted: with the whole collection in one shard there is one for each item.
    assert sum(a for a, _ in told[-4:]) == len({q for q, (_, t) in enumerate(items) if t and t != "nothing has this"})


def test_shards_are_left_out_only_below_the_tenth_score(spark):
    docs = _corpus(1200, seed=8)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    told = []
    items = [(i, docs[i][1]) for i in range(0, 1200, 50)]
    got = S.search(S.build(table, shard_docs=40), spark.createDataFrame(items, "item_id long, text string"), told=lambda a, b: told.append((a, b))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plainly(docs, items)))
    assert sum(a for a, _ in told) < told[0][1]  # the bounds spare some visits


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for some in (docs.limit(0), docs.filter("doc_id > 5").unionByName(spark.createDataFrame([(3, "..")], docs.schema))):
        assert S.search(S.build(some), items).count() == 0
    assert S.search(S.build(docs), items.limit(0)).count() == 0


def test_bisection_brings_like_documents_together(spark):
    draw = random.Random(2)
    kinds = [i % 4 for i in range(2000)]
    docs = spark.createDataFrame([(i, " ".join(f"k{k}w{draw.randrange(60)}" for _ in range(40))) for i, k in enumerate(kinds)], "doc_id long, text string")
    index = S.build(docs, shard_docs=250)
    by = defaultdict(Counter)
    for r in index.places.collect():
        by[r.shard][kinds[r.id]] += 1
    assert len(by) >= 4 and sum(max(c.values()) for c in by.values()) / 2000 > 0.9
    assert max(sum(c.values()) for c in by.values()) < 800


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, S.BINS - 1), st.integers(0, 30)), max_size=12), st.lists(st.tuples(st.integers(0, S.BINS - 1), st.integers(0, 30)), max_size=12))
def test_as_many_go_right_as_left_and_each_pair_gains(left, right):
    counts = np.zeros((1, 2, S.BINS), np.int64)
    for s, side in enumerate((left, right)):
        for b, n in side:
            counts[0, s, b] += n
    chance, moved = S.exchange(counts)
    go = np.rint(chance * counts).astype(int)
    assert go[0, 0].sum() == go[0, 1].sum() == moved
    worth = (np.arange(S.BINS) - S.BINS // 2) * S.BIN_WIDTH
    pairs = zip(*[np.repeat(worth[::-1], go[0, s][::-1]) for s in (0, 1)], strict=True)
    assert all(a + b > 0 for a, b in pairs)


def test_gains_are_the_bits_saved():
    deg = np.zeros((1, 2, S.FEATURES + 1), np.int64)
    deg[0, :, 0] = 10, 10
    deg[0, :, 5] = 3, 4
    gain = S.move_gains(deg)

    def bits(a, b):
        return a * math.log2(10 / (a + 1)) + b * math.log2(10 / (b + 1))

    assert gain[0, 0, 4] == pytest.approx(bits(3, 4) - bits(2, 5)) and gain[0, 1, 4] == pytest.approx(bits(3, 4) - bits(4, 3))


@pytest.mark.parametrize("counts", [[], [1, 2, 255], [1, 256, 70_000]])
def test_counts_are_unpacked_as_they_were(counts):
    assert S.unpacked(S.packed(counts), len(counts)).tolist() == counts


def test_query_gives_the_rows_of_its_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = S.op11_ranked_search(spark, SF).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, db.execute(S.ORACLE_SQL).fetchall()))
