"""Cleaning of harvested strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.binding import let


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(P.SPACES))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{P.WS}]+", " "))


def is_sentinel(text: Column) -> Column:
    """Whether a string is markup for 'no value yet'; null stays null."""
    return text.rlike(P.SENTINEL) | F.lower(strip(text)).isin("loading...", "loading…")


#: The named references that do not need a parser; `sources.pages` decodes the rest at the boundary.
ENTITIES = (("&nbsp;", "\u00a0"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape_common(text: Column) -> Column:
    """Decode the common named references, ``&amp;`` last so that nothing is decoded twice."""
    for name, plain in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def clean_text(text: Column, decoded: Column | None = None) -> Column:
    """A harvested string made presentable, or null if nothing is left.

    Tags become spaces, references are decoded, white space is collapsed, sentinels are rejected.
    ``decoded`` is the text as the page boundary decoded it, where that is at hand.
    """
    plain = unescape_common(F.regexp_replace(text, "<[^>]+>", " "))
    if decoded is not None:
        plain = F.coalesce(decoded, plain)
    return let(collapse(plain), lambda t: F.when((t != "") & ~is_sentinel(t), t))


def drop_title_suffix(title: Column) -> Column:
    """A page title without the shop's name after the last separator."""
    return strip(F.regexp_replace(title, P.TITLE_SUFFIX, ""))


def slug(text: Column) -> Column:
    """Letters and digits in lower case, anything else as single dashes, 60 characters at most."""
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 60)


def category_segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, ">"), lambda s: strip(s)), lambda s: s != "")


def type_name(raw: Column) -> Column:
    """``http://schema.org/Product``, ``schema:Product`` and ``Product`` as ``Product``."""
    first = F.regexp_extract(strip(raw), rf"\A[^{P.WS}]+", 0)
    return F.regexp_extract(F.regexp_replace(first, "/+$", ""), r"[^/#:]*$", 0)


def first_sentence(text: Column) -> Column:
    """Up to the first ``.``, ``!`` or ``?`` that white space follows."""
    whole = strip(text)
    return F.regexp_extract(whole, rf"(?s)\A(?:.*?[.!?](?=[{P.WS}])|.*)", 0)
