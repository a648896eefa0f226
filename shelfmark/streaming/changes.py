"""Price and stock of offers over time: what changed, and what was not seen again.

:func:`changes` reads a table, :func:`changes_of_stream` keeps one state an offer and reads a stream;
both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE = "offer string, at timestamp, kind string, before double, after double"
STATE = "seen timestamp, price double, stock double, stale boolean"


def sightings(rows: DataFrame) -> DataFrame:
    """``offer``, ``at``, ``price``, ``stock``: one row for each offer and time, the lowest price and the stock of all of them.

    Rows without an offer or a time are left out.
    """
    named = rows.filter("offer is not null and at is not null")
    return named.groupBy("offer", "at").agg(F.min("price").alias("price"), F.sum("stock").alias("stock"))


def changes(seen: DataFrame, age_days: int, until: str) -> DataFrame:
    """``offer``, ``at``, ``kind``, ``before``, ``after`` from rows of :func:`sightings`.

    ``new``: seen for the first time, or again after it was stale.  ``price``, ``stock``: another
    value than at the time before.  ``stale``: not seen for ``age_days`` from then on (``at`` is when
    they were over), if that was before ``until``, the time up to which all is known.
    """
    order = Window.partitionBy("offer").orderBy("at")
    age = F.expr(f"INTERVAL {age_days} DAYS")
    told = seen.select("offer", F.col("at").cast("timestamp").alias("at"), "price", "stock").withColumns({
        "was": F.lag("price").over(order), "had": F.lag("stock").over(order), "last": F.lag("at").over(order), "next": F.lead("at").over(order),
    })
    fresh = F.col("last").isNull() | (F.col("at") > F.col("last") + age)
    due = F.col("at") + age
    rows = F.array_compact(F.array(
        F.when(fresh, F.struct("at", F.lit("new").alias("kind"), F.lit(None).cast("double").alias("before"), F.col("price").alias("after"))),
        F.when(~fresh & ~F.col("was").eqNullSafe(F.col("price")), F.struct("at", F.lit("price").alias("kind"), F.col("was").alias("before"), F.col("price").alias("after"))),
        F.when(~fresh & ~F.col("had").eqNullSafe(F.col("stock")), F.struct("at", F.lit("stock").alias("kind"), F.col("had").alias("before"), F.col("stock").alias("after"))),
        F.when((F.col("next").isNull() | (F.col("next") > due)) & (due < F.lit(until).cast("timestamp")), F.struct(due.alias("at"), F.lit("stale").alias("kind"), F.col("price").alias("before"), F.lit(None).cast("double").alias("after"))),
    ))
    return told.select("offer", F.explode(rows).alias("x")).select("offer", "x.*")


class _Offers(StatefulProcessor):
    """State of one offer: when it was seen last, and with what; a timer for when it grows stale."""

    def __init__(self, age_days: int) -> None:
        self.age = pd.Timedelta(days=age_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("offer", STATE)

    def _timer(self, at: pd.Timestamp) -> int:
        return int((at + self.age).timestamp() * 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values("at")
        found = some.groupby("at", sort=True).agg({"price": "min", "stock": "sum"})
        held = self.state.get() if self.state.exists() else None
        seen, price, stock, stale = held if held is not None else (None, None, None, True)
        seen = pd.Timestamp(seen) if seen is not None else None
        out: list[tuple] = []
        for at, new_price, new_stock in found.itertuples():
            if seen is not None and at <= seen:
                continue  # late: what was known then has been told
            if seen is not None and not stale and at > seen + self.age:
                out.append((seen + self.age, "stale", price, None))
                stale = True
            if stale:
                out.append((at, "new", None, new_price))
            else:
                out += [(at, kind, old, new) for kind, old, new in (("price", price, new_price), ("stock", stock, new_stock)) if old != new]
            if seen is not None:
                self.handle.deleteTimer(self._timer(seen))
            seen, price, stock, stale = at, float(new_price), float(new_stock), False
            self.handle.registerTimer(self._timer(seen))
        self.state.update((seen.to_pydatetime(), price, stock, stale))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, price, stock, stale = self.state.get()
        seen = pd.Timestamp(seen)
        if not stale and expiredTimerInfo.getExpiryTimeInMs() == self._timer(seen):
            self.state.update((seen.to_pydatetime(), price, stock, True))
            yield self._rows(key, [(seen + self.age, "stale", price, None)])

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"offer": [key[0]] * len(out), "at": pd.Series([r[0] for r in out], dtype="datetime64[us]"), "kind": [r[1] for r in out], "before": pd.Series([r[2] for r in out], dtype="float64"), "after": pd.Series([r[3] for r in out], dtype="float64")})

    def close(self) -> None:
        pass


def changes_of_stream(seen: DataFrame, age_days: int, delay: str = "0 seconds") -> DataFrame:
    """The rows of :func:`changes` from a stream of ``offer``, ``at``, ``price``, ``stock``.

    All that is said of a time should arrive in one batch, and times in order up to ``delay``; rows
    later than that, or not after what is known of their offer, are passed over.  A stale offer is
    told once the watermark has passed its time.  Needs the RocksDB state store.
    """
    named = seen.filter("offer is not null and at is not null").withWatermark("at", delay)
    return named.groupBy("offer").transformWithStateInPandas(_Offers(age_days), CHANGE, outputMode="Append", timeMode="EventTime")
