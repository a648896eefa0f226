"""Axes, labels and stock states of variant rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.binding import let
from shelfmark.functions.text import strip


def axis_of_key(key: Column) -> Column:
    """``color``, ``colorId`` and ``colours`` as ``Color``; null for keys that name no axis."""
    axes = F.create_map(*[F.lit(x) for pair in P.AXES.items() for x in pair])

    def listed(word: Column) -> Column:
        # Most keys name no axis, which a set says sooner than a map of the plan.
        return F.when(word.isin(*P.AXES), F.try_element_at(axes, word))

    def known(word: Column) -> Column:
        of_id = F.when(word.rlike(P.AXIS_ID_KEY), let(F.regexp_extract(word, P.AXIS_ID_KEY, 1), listed))
        return F.coalesce(listed(word), of_id, F.when(word.endswith("s"), let(F.regexp_replace(word, "(?:es|s)$", ""), listed)))

    return let(F.lower(strip(key)), known)


def is_axis_id_key(key: Column) -> Column:
    return key.rlike(P.AXIS_ID_KEY)


def is_null_choice(value: Column) -> Column:
    return F.lower(strip(value)).isin(*P.NULL_CHOICES)


def axis_title(name: Column) -> Column:
    """A known axis by its name, any other in title case; URLs of properties by their last segment."""
    plain = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "[^/]*$", 0)
    return let(plain, lambda p: F.coalesce(axis_of_key(p), F.initcap(p)))


def stock_of(kind: Column, text: Column, number: Column) -> Column:
    """Stock state of one value by its kind; null if it does not say."""
    by_text = F.when(text.rlike(P.PREORDER), "preorder").when(text.rlike(P.OUT_OF_STOCK), "out_of_stock").when(text.rlike(P.IN_STOCK), "in_stock")
    return (
        F.when(kind == "bool", F.when(text == "true", "in_stock").otherwise("out_of_stock"))
        .when(kind == "num", F.when(number > 0, "in_stock").otherwise("out_of_stock"))
        .when(kind == "str", by_text)
    )


def swatch_color(name: Column, colors: Column) -> Column:
    """The first part of a colour name that is in the array ``colors`` of CSS names, or null.

    Whole parts (squashed) go before single words, so that ``Navy Blue`` is not read as ``Blue``.
    """
    parts = F.filter(F.transform(F.split(name, r"[/,+&]|\s-\s"), lambda p: F.lower(strip(p))), lambda p: p != "")
    whole = F.transform(parts, lambda p: F.regexp_replace(p, rf"[{P.WS}]+", ""))
    words = F.flatten(F.transform(parts, lambda p: F.split(p, rf"[{P.WS}]+")))
    return F.try_element_at(F.filter(F.concat(whole, words), lambda c: F.array_contains(colors, c)), F.lit(1))
