from __future__ import annotations

import math

import numpy as np
import pytest

from shelfmark.llm import embed as E

SCHEMA = "vec_id long, embedding array<double>, label int, node int, links string"


def _vectors(seed, n, dim=24, groups=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, dim))
    out = [(i, (base[i % groups] * rng.uniform(0.1, 9) + rng.standard_normal(dim) * rng.choice([0.02, 0.12, 0.2, 2.0])).tolist()) for i in range(n)]
    return [(i, v, i % 3) for i, v in out]


def brute(rows):
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = []
    for i, v, lab in rows:
        a = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(1)
        if lab is not None and v and np.isfinite(a).all() and (a != 0).any():
            good.append((i, a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()), lab))
    for p, (i, a, lab) in enumerate(good):
        for j, b, other in good[p + 1 :]:
            if lab == other and len(a) == len(b) and float(a @ b) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (links[i], find(i)) for i, *_ in rows}


def _run(spark, rows):
    return {r.id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()}


def test_links_and_components_are_those_of_brute_force(spark):
    rows = _vectors(1, 400)
    assert _run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [2, 5])
def test_bucketed_search_loses_nothing(spark, monkeypatch, bits):
    rows = _vectors(2, 300)
    monkeypatch.setattr(E, "choose_bits", lambda *a: bits)
    assert _run(spark, rows) == brute(rows)


def test_many_small_blocks(spark, monkeypatch):
    rows = _vectors(3, 300)
    monkeypatch.setattr(E, "BLOCK", 16)
    assert _run(spark, rows) == brute(rows)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, -0.0], 0), (10, [1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1e-300, 0.0], 0), (13, [1e300, 0.0], 0), (14, [-1.0, 0.0], 0), (15, [1.0, 0.0], 1)]
    assert _run(spark, rows) == brute(rows)


def test_copies_count_without_pairs(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(500)] + [(900, [1.0, 2.0, 3.01], 0)]
    got = _run(spark, rows)
    assert set(got.values()) == {(500, 0)}


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted((r.id, r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal(48), rng.standard_normal(48)
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    y = 0.7 * x + math.sqrt(1 - 0.49) * (y - (y @ x) * x) / np.linalg.norm(y - (y @ x) * x)
    got = []
    for k in range(600):
        r = E.rotation(48, k)
        turned = y @ r
        s = np.sign(turned) / math.sqrt(48)
        c = s @ turned
        estimate = (x @ r) @ s / c
        assert abs(estimate - 0.7) <= math.sqrt(1 - 0.49) * math.sqrt(1 - c * c) / c + 1e-9
        got.append(estimate)
    assert abs(np.mean(got) - 0.7) < 0.02


def test_most_pairs_need_no_exact_computation():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((500, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    _, _, exact = E.linked(v, v, 0.98)
    assert exact < 0.02 * 500 * 500


@pytest.mark.parametrize("dim", [1, 2, 3, 7, 64])
def test_codes_rule_out_no_link(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((60, dim))
    x[:5] = np.eye(dim)[rng.integers(dim, size=5)]
    v = np.concatenate([x + rng.standard_normal((60, dim)) * s for s in (0.0, 0.01, 0.05, 0.1, 0.2)])
    v = v[(v != 0).any(axis=1)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    i, j, _ = E.linked(v, v, 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(len(v)) for b in range(len(v)) if float(v[a] @ v[b]) >= 0.98}


def test_exact_mode_and_tables_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(*r, 1, "x") for r in _vectors(6, 250)], SCHEMA)
    exact = sorted(map(tuple, E.near_vectors(rows, exact=True).collect()))
    monkeypatch.setattr(E, "choose_bits", lambda *a: 4)
    assert exact == sorted(map(tuple, E.near_vectors(rows).collect()))


def test_plan_grows_slower_than_pairs():
    assert E.choose_bits(5000) == 0 and E.choose_bits(10**8) > 8
    for bits in (1, 8, 20):
        assert (1 - E.agreement() ** bits) ** E.tables_for(bits) <= E.MISS


def test_empty_table(spark):
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
