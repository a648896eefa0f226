from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash as S
from shelfmark.llm.components import connected_components

SCHEMA = "doc_id long, text string, component_id int"  # the last column clashes with the operator's own


def slow_print(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "x y z", "É É é é a b c", "a\x0bb\x0cc\x1cd e", "na me " * 50, "  x y z w"])
def test_fingerprint_is_the_definition(text):
    assert S.fingerprint(text) == slow_print(text)


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    upper, lower, errors = S._syndromes()
    left = words ^ errors[upper[words >> 11] ^ lower[words & 0x7FF]]
    assert (upper[left >> 11] ^ lower[left & 0x7FF] == 0).all()
    assert np.bitwise_count(words ^ left).max() <= 3
    counts = (S.nearby(words) >= 0).sum(axis=1)
    assert set(counts.tolist()) == {1, 6}


@pytest.mark.parametrize("segments", [4, 5])
def test_every_pair_within_three_bits_shares_a_key(segments):
    rng = np.random.default_rng(segments)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, size=i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    rows, keys = S.keys_of(a, segments, False)
    filed = {}
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        filed.setdefault(r, set()).add(k)
    rows, keys = S.keys_of(b, segments, True)
    sought = {}
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        sought.setdefault(r, set()).add(k)
    assert all(filed[i] & sought[i] for i in range(len(a)))


def test_pairs_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    prints = {int(p) for p in base}
    for p in base:
        for _ in range(12):
            q = int(p)
            for bit in rng.choice(64, size=int(rng.integers(1, 5)), replace=False):
                q ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
            prints.add(q)
    prints = sorted(prints)
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    got = S.linked_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert {(r.a, r.b) for r in got} == want


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1090)] + [(2000, i) for i in range(2001, 2300)] + [(5, None), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {v: find(v) for v in list(root) if find(v) != v}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want


def _docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "alpha beta gamma delta"), (3, "ALPHA beta\tgamma  delta"), (9, "alpha beta gamma delta"), (9, "alpha beta gamma delta"), (1, None), (2, ""), (4, "  "), (None, "alpha beta gamma delta"), (None, "quite another text here"), (11, long), (10, long + " "), (6, "nothing like the others at all")]
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def test_nulls_ties_and_long_texts(spark):
    got = {(r.id, r.component_id) for r in S.near_duplicates(_docs(spark)).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (None, 3), (1, 1), (2, 1), (4, 1), (None, None), (11, 10), (10, 10), (6, 6)}


def test_one_row_of_each_group_stays_with_its_columns(spark):
    docs = _docs(spark).withColumn("id", F.lit("x")).withColumn("fp", F.lit(1))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 6, 10]


def test_repeated_smallest_row_stays_once(spark):
    docs = spark.createDataFrame([(1, "a b c", 0)] * 5 + [(2, "a b c", 0)], SCHEMA)
    assert [r.doc_id for r in S.keep_one(docs).collect()] == [1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0
    assert S.keep_one(empty).count() == 0


def test_keys_are_never_broadcast(spark):
    # The fingerprints of 100,000 texts are a small table, their keys are not.
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = S.linked_pairs(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
