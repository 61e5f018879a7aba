"""Date normalisers; an unreadable date is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitgate.functions.text import clean_text, unescape

NO_DATE = "1970-01-01"


def _digits_or_iso(text: Column) -> Column:
    dashed = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return F.try_to_date(F.regexp_extract(dashed, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 0), "yyyy-MM-dd")


def strict_date(col: Column) -> Column:
    """``yyyymmdd`` or ISO after text cleaning."""
    return _digits_or_iso(clean_text(col))


def lenient_date(col: Column) -> Column:
    """Also ``/`` and ``.`` separators, a time part, and 1970-01-01 for "no date"."""
    text = F.trim(unescape(F.coalesce(col.cast("string"), F.lit(""))))
    head = F.translate(F.substring(text, 1, 10), "/.", "--")
    return F.when(text != NO_DATE, _digits_or_iso(head))


def date_in_text(col: Column) -> Column:
    """The first ``2026年7月24``-like date inside free text."""
    pattern = r"(20[0-9]{2})[-年/.]([0-9]{1,2})[-月/.]([0-9]{1,2})"
    year, month, day = (F.regexp_extract(col, pattern, i) for i in (1, 2, 3))
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "", F.try_to_date(text, "yyyy-MM-dd"))


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def active_on(start: Column, end: Column, day: Column) -> Column:
    """Half-open life: ``start <= day`` and ``day < end`` where there is an end."""
    return (day >= start) & (end.isNull() | (day < end))


def overlaps(start: Column, end: Column, cover_start, cover_end) -> Column:
    return (start <= F.lit(cover_end)) & (end.isNull() | (end > F.lit(cover_start)))
