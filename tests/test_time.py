from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from shelfmark.operators.asof import as_of
from shelfmark.streaming import changes as C

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("width", ["1 hour", "3 days", "400 days"])
def test_as_of_is_the_latest_entry_not_after(spark, width):
    draw = random.Random(3)
    # Key 0 holds most rows; key 9 has no history, null keys and times have no entry.
    keys = [0] * 6 + [1, 2, 9, None]
    rows = [(i, draw.choice(keys), None if i % 41 == 0 else START + timedelta(minutes=30 * draw.randrange(400)), "x") for i in range(400)]
    past = [(draw.choice([0, 0, 0, 1, 2, None]), START + timedelta(minutes=30 * draw.randrange(400)), float(draw.randrange(9))) for _ in range(120)] + [(1, None, 1.0)]
    got = as_of(spark.createDataFrame(rows, "id int, k int, at timestamp, _time string"), spark.createDataFrame(past, "k int, since timestamp, v double"), "k", "at", "since", ["v"], width).collect()

    def plainly(key, at):
        met = [(since, v) for k, since, v in past if k is not None and k == key and since is not None and at is not None and since <= at]
        return max(met)[1] if met else None

    assert sorted((r.id, r.v) for r in got) == [(i, plainly(k, at)) for i, k, at, _ in rows]
    assert got[0]._time == "x" and any(r.v is not None for r in got)


def test_as_of_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, START)], "k int, at timestamp")
    past = spark.createDataFrame([], "k int, since timestamp, v double")
    assert as_of(rows, past, "k", "at", "since", ["v"]).collect()[0].v is None
    assert as_of(rows.limit(0), past, "k", "at", "since", ["v"]).count() == 0


def test_changes_of_one_offer(spark):
    day = [START + timedelta(days=d) for d in (0, 1, 2, 20)]
    seen = spark.createDataFrame([("a", day[0], 5.0, 1.0), ("a", day[1], 6.0, None), ("a", day[2], 6.0, 3.0), ("a", day[3], 6.0, 3.0), ("a", day[3], 5.5, 1.0)], C.CHANGE.split(", kind")[0] + ", price double, stock double")
    got = sorted((r.at, r.kind, r.before, r.after) for r in C.changes(C.sightings(seen), 7, "2024-01-25").collect())
    assert got == sorted([(day[0], "new", None, 5.0), (day[1], "price", 5.0, 6.0), (day[1], "stock", 1.0, None), (day[2], "stock", None, 3.0), (day[2] + timedelta(days=7), "stale", 6.0, None), (day[3], "new", None, 5.5)], key=lambda r: r[:2])
