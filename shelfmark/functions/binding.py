"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A column used in several places of an expression is copied into each; nested, the copies
    multiply until the plan does not fit the driver.  Here it becomes a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
