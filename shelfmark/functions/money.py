"""Amounts and currencies as pages write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.binding import let
from shelfmark.functions.text import strip

_GAP = rf"[{P.WS}]*"
#: What a currency mark can begin with: without it every mark would be tried at every character.
_MARK_AHEAD = r"(?=[A-Zz$£€¥₹₽₺₩￥＄￡￦])"
_SIGN = "[$£€¥₹₽₺₩￥＄￡￦]"
#: A sign next to another one is a rule of signs and no currency: ``$$$`` after a telephone number makes it no price.
_MARK = rf"{_MARK_AHEAD}(?<!{_SIGN}){P.CURRENCY}(?!{_SIGN})"
MONEY = rf"{_MARK}{_GAP}{P.NUMBER}|{P.NUMBER}{_GAP}{_MARK}"


def _after_last(text: Column, mark: str) -> Column:
    """How many characters follow the last ``mark``, plus one; 0 without one."""
    return F.instr(F.reverse(text), mark)


def parse_localized(raw: Column, bare: bool = False) -> Column:
    """A number in any grouping convention, or null; ``bare`` says that it has no white space around it.

    With both marks the last is the decimal one.  A single kind of mark groups if it recurs or has
    just three digits after it, and is the decimal mark otherwise.
    """

    def lone(text: Column, mark: str, at: Column) -> Column:
        marks = F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
        return F.when((marks > 1) | (at == 4), "").otherwise(mark)

    def decimal(text: Column) -> Column:
        return let(F.struct(_after_last(text, ".").alias("dot"), _after_last(text, ",").alias("comma")), lambda last: marked(text, last["dot"], last["comma"]))

    def marked(text: Column, dot: Column, comma: Column) -> Column:
        both = F.when(dot < comma, ".").otherwise(",")
        return F.when((dot > 0) & (comma > 0), both).when(dot > 0, lone(text, ".", dot)).when(comma > 0, lone(text, ",", comma)).otherwise("")

    def read(text: Column, mark: Column) -> Column:
        plain = F.when(mark == ".", F.replace(text, F.lit(","), F.lit(""))).when(mark == ",", F.translate(text, ",.", ".")).otherwise(F.translate(text, ".,", ""))
        return F.when(text.rlike(r"\A-?[0-9][0-9.,]*\z"), plain.try_cast("double"))

    return let(F.translate(raw if bare else strip(raw), P.GROUPING_SPACES, ""), lambda text: let(decimal(text), lambda mark: read(text, mark)))


def credible(amount: Column) -> Column:
    """The amount if it can be a price: above zero and at most ten million."""
    return let(amount, lambda a: F.when((a > 0) & (a <= P.MOST_AMOUNT), a))


def amount_of(text: Column) -> Column:
    return credible(parse_localized(text))


def amount_of_value(kind: Column, text: Column, number: Column) -> Column:
    """The amount of a JSON value by its kind; booleans are not numbers here."""
    return F.when(kind == "num", credible(number)).when(kind == "str", amount_of(text))


def symbol_currency(token: Column) -> Column:
    """ISO code of a currency symbol, by a map that is part of the plan; null if ambiguous or unknown."""
    pairs = [F.lit(x) for pair in P.SYMBOLS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), token)


def currency_of(text: Column) -> Column:
    """A stated currency: a three-letter code in upper case, or that of a symbol."""
    return let(strip(text), lambda t: F.when(t.rlike(r"\A[A-Za-z]{3}\z"), F.upper(t)).otherwise(symbol_currency(t)))


def money_mentions(text: Column) -> Column:
    """All amounts with a currency mark in a text: array of ``amount``, ``currency`` in order."""

    def coded(mark: Column) -> Column:
        return let(F.upper(F.rtrim(strip(mark), F.lit("."))), lambda t: F.coalesce(symbol_currency(t), F.when(F.length(t) == 3, t)))

    def read(found: Column) -> Column:
        # Marks hold no digits and numbers begin and end with one, so that the parts need no second search for marks.
        number = F.regexp_extract(found, "[0-9](?:.*[0-9])?", 0)
        return let(number, lambda n: F.struct(credible(parse_localized(n, bare=True)).alias("amount"), coded(F.replace(found, n, F.lit(""))).alias("currency")))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({MONEY})"), F.lit(1)), read), lambda m: m["amount"].isNotNull())


def discount_percent(price: Column, compare_at: Column) -> Column:
    """Whole percent saved, half up; null unless the compared price is higher."""
    return F.when((compare_at != 0) & (compare_at > price), F.floor((1 - price / compare_at) * 100 + 0.5).cast("int"))


def effective_price(base: Column, variant: Column) -> Column:
    """The price shown for a chosen variant; both are structs of price, currency, compare_at_price.

    A variant that only restates the product's price keeps the product's markdown.
    """
    restated = (variant["price"].eqNullSafe(base["price"])) & (variant["currency"].eqNullSafe(base["currency"]))
    has_own = F.coalesce(variant["compare_at_price"], F.lit(0.0)) != 0
    return F.when(variant.isNull(), base).when(~restated | has_own, variant).otherwise(base)


def format_price(value: Column, currency: Column) -> Column:
    """``USD 1,234`` for whole amounts and ``USD 1,234.50`` for others."""
    number = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.concat_ws(" ", currency, number)
