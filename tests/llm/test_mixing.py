from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing as X

SCHEMA = "doc_id long, text string, source string, copies string, row_key int, size int"


def _docs(spark, sizes):
    return spark.createDataFrame([(i, " ".join(["w"] * n) if n is not None else None, s, "c", 1, 2) for i, (s, n) in enumerate(sizes)], SCHEMA)


def slow_targets(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    share = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(share[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * share[s] / weight > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else rest * share[s] / weight for s in names}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 3, "c": 5, "d": 40}, {"a": 7, None: 900, "é": 10, "Z": 1, "z": 2, "zz": 3}, {"x": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 10, "c": 10}])
def test_targets_are_those_of_repeated_sharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in X.targets(table).collect()}
    assert got == pytest.approx(slow_targets(sizes), abs=1e-6) if sum(sizes.values()) else all(v == 0 for v in got.values())


def test_taken_words_meet_the_targets_and_reruns_agree(spark):
    sizes = [("hot", 5 + i * 7 % 40) for i in range(3000)] + [("b", 1 + i % 9) for i in range(400)] + [(None, 20)] * 50 + [("tiny", 3)] * 4
    docs = _docs(spark, sizes)
    rows = X.mix(docs).collect()
    again = X.mix(docs.repartition(5)).collect()
    assert sorted((r.id, r.taken) for r in rows) == sorted((r.id, r.taken) for r in again)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
        rate = own[0].target / own[0].source_size
        assert {r.copies for r in own} <= {int(rate), int(rate) + 1}
        assert max(r.copies for r in own) <= 3


def test_weights_bend_the_choice_within_the_cap(spark):
    docs = _docs(spark, [("a", 10)] * 300 + [("b", 10)] * 900)
    rows = X.mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(1.0)).collect()
    for source in ("a", "b"):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
        heavy, light = (sum(r.taken for r in own if r.id % 2 == k) for k in (0, 1))
        assert heavy > 2 * light and max(r.copies for r in own) <= 3


def test_empty_texts_and_clashing_columns(spark):
    docs = _docs(spark, [("a", None), ("a", 0), ("a", 4), ("b", 4)])
    rows = {r.id: r for r in X.mix(docs).collect()}
    assert rows[0].size == rows[1].size == rows[0].taken == rows[1].copies == 0
    again = X.repeated(docs)
    assert again.columns == docs.columns
    assert sum(1 for _ in again.collect()) == sum(r.copies for r in rows.values())


@pytest.mark.parametrize(("copies", "words"), [(1500, 20)])
def test_repeated_rows_meet_the_target(spark, copies, words):
    docs = spark.createDataFrame([(1, " ".join(["w"] * words), "s", "c", 1, 2)] * copies + [(i, "d e f", "t", "c", 1, 2) for i in range(2, 9)], SCHEMA).repartition(5)
    rows = X.mix(docs, weight=X.longer_more).collect()
    for source, most in (("s", words), ("t", 3)):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= most / 2 and max(r.copies for r in own) <= 3
    again = X.mix(docs.repartition(3), weight=X.longer_more).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert X.repeated(docs, weight=X.longer_more).count() == sum(r.copies for r in rows)


def slow_rate(docs, target, cap=3.0):
    rate, full = 0.0, set()
    while True:
        open_ = sum(w * n for i, (n, w, _) in docs.items() if i not in full)
        rate = max(0.0, target - cap * sum(docs[i][0] for i in full)) / open_ if open_ else math.inf
        over = {i for i, (n, w, _) in docs.items() if i not in full and w * rate >= cap}
        if not over:
            return rate
        full |= over


def test_taken_documents_are_those_of_a_plain_sort(spark):
    sizes = [("a", 1 + i * i % 97) for i in range(200)] + [("b", 1 + i % 60) for i in range(60)] + [(None, 500), (None, 20), (None, 3)] + [("tiny", 4)] * 3
    table = _docs(spark, sizes)
    keys = {r.id: (r.size, r.w, r.row_key) for r in X._rows(table, "doc_id", "text", "source", X.longer_more, X.SEED, [F.col("doc_id").alias("id")]).collect()}
    got = {r.id: r for r in X.mix(table, weight=X.longer_more).collect()}
    for source in {s for s, _ in sizes}:
        docs = {i: keys[i] for i, (s, _) in enumerate(sizes) if s == source}
        target = next(got[i].target for i in docs)
        rate = slow_rate(docs, target)
        copies, ranked = {}, []
        for i, (n, w, key) in docs.items():
            times = min(3.0, w * rate)
            copies[i], p, u = math.floor(times), times - math.floor(times), (key % (1 << 52) + 0.5) / (1 << 52)
            if copies[i] < 3:
                ranked.append(((u / (1 - u)) / (p / (1 - p)) if p else math.inf, i))
        left = target - sum(copies[i] * docs[i][0] for i in docs)
        order = [i for _, i in sorted(ranked)]
        while order and left >= docs[order[0]][0]:
            left -= docs[order[0]][0]
            copies[order.pop(0)] += 1
        if left >= 0.5 and order and (near := min(order, key=lambda i: abs(docs[i][0] - left))) is not None and abs(docs[near][0] - left) < left:
            copies[near] += 1
        assert {i: got[i].copies for i in docs} == copies, source


def test_unequal_weights_draw_unequally(spark):
    rows = X.mix(_docs(spark, [("a", 2 if i % 2 else 40) for i in range(2000)] + [("b", 40)] * 500), weight=X.longer_more).filter("source = 'a'").collect()
    long, short = ([r.copies for r in rows if r.size == n] for n in (40, 2))
    assert sum(long) / len(long) > 1.5 * sum(short) / len(short)


def test_a_source_that_must_give_all_and_weights_that_are_none(spark):
    docs = _docs(spark, [("a", 1), ("a", 7), ("a", 300), ("b", 90_000)])
    rows = {r.id: r for r in X.mix(docs, weight=X.longer_more).collect()}
    assert [rows[i].copies for i in (0, 1, 2)] == [3, 3, 3]
    none = X.mix(docs, weight=F.when(F.col("doc_id") == 2, float("nan"))).collect()
    assert len(none) == 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.mix(empty).count() == 0 and X.repeated(empty).count() == 0
