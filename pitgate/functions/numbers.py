"""Strict and lenient number normalisers.

The strict forms give null for anything that is not a clean number or does not fit, for the
caller to report; the lenient forms give zero for what is no number. They are different
operators on purpose. Nothing is rounded before it is tested.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitgate.functions.text import unescape

_DECIMAL = "decimal(18,6)"
_EXACT = "decimal(30,12)"
_WIDE = "decimal(38,12)"
_PLACES = 12
_EXPONENT = r"^[+-]?([0-9]*)\.?([0-9]*)[eE]([+-]?[0-9]+)$"


def _bare(col: Column) -> Column:
    return F.trim(F.replace(col.cast("string"), F.lit(","), F.lit("")))


def _too_fine(text: Column) -> Column:
    """Whether a number has a digit beyond the twelfth decimal that is not zero, which the exact types cannot
    hold; in exponent form the point is moved first."""
    part = lambda i: F.regexp_extract(text, _EXPONENT, i)
    digits = F.concat(part(1), part(2))
    kept = F.regexp_replace(digits, "0+$", "")
    places = F.length(part(2)) - (F.length(digits) - F.length(kept)) - part(3).try_cast("int")
    moved = (F.length(kept) > 0) & F.coalesce(places > _PLACES, part(3).startswith("-"))
    short = (F.length(text) <= _PLACES + 1) & ~F.contains(F.lower(text), F.lit("e"))
    return F.when(short, F.lit(False)).when(text.rlike(_EXPONENT), moved).otherwise(text.rlike(rf"\.[0-9]{{{_PLACES}}}[0-9]*[1-9]"))


def _exact(col: Column, kind: str) -> Column:
    """The number in a type that holds it without rounding, or null."""
    text = _bare(col)
    return F.when(~_too_fine(text), text.try_cast(kind))


def strict_decimal(col: Column, kind: str = _DECIMAL) -> Column:
    """The number as ``kind``; null for text that is no number, and for a number that ``kind``
    would round or cannot hold."""
    value = _exact(col, _EXACT)
    held = value.try_cast(kind)
    return F.when(held == value, held)


def lenient_decimal(col: Column, kind: str = _WIDE) -> Column:
    """The number as ``kind``, and 0 for text that is no number. A number too large for
    ``kind`` is null, not 0: it is not missing."""
    text = _bare(unescape(col.cast("string")))
    number = text.try_cast(kind)
    return F.when(number.isNotNull() | text.try_cast("double").isNotNull(), number).otherwise(F.lit(0).cast(kind))


def non_negative_price(col: Column) -> Column:
    value = strict_decimal(col)
    return F.when(value >= 0, value)


def non_negative_integer(col: Column, multiplier: int = 1) -> Column:
    """Whole shares or money after a unit conversion; null unless it comes out whole."""
    value = _exact(col, _EXACT) * F.lit(multiplier).cast("decimal(7,0)")
    whole = value.try_cast("bigint")
    return F.when((value >= 0) & (whole == value), whole)


def per_ten(col: Column) -> Column:
    """A ratio per ten shares as a ratio per share."""
    return (col.try_cast(_EXACT) / F.lit(10)).try_cast(_DECIMAL)


def ohlc_valid(o: Column, h: Column, l: Column, c: Column) -> Column:
    return (
        (F.least(o, h, l, c) >= 0) & (h >= F.greatest(o, l, c)) & (l <= F.least(o, h, c))
    )
