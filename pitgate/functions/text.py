"""Text cleaning as Column expressions (no Python in the row path)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x1c-\x1f]+"
# What HTML calls a character reference: decimal, hexadecimal, or a name with or without ";".
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_CLOSED = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\f <&#;]{1,32});"
_NO_CHARACTER = 0xFFFD


def _windows(number: int) -> str:
    """What browsers make of a reference to a C1 control: the character of code page 1252."""
    try:
        return bytes([number]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(number)


def _table(pairs: dict) -> Column:
    """A constant map from text to text."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _code_point(number: Column) -> Column:
    """The character of a numeric reference: U+FFFD where there is none, empty where there may not be one."""
    known = {0: chr(_NO_CHARACTER), 13: "\r", **{n: _windows(n) for n in range(0x80, 0xA0)}}
    banned = (number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
              | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE))
    outside = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    safe = F.when(outside, F.lit(_NO_CHARACTER)).otherwise(number)
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(_table(known), number.cast("string")), F.when(~outside & banned, F.lit("")).otherwise(char))


def _number(digits: Column, base: int) -> Column:
    """The value of a run of digits; anything long is beyond Unicode."""
    bare = F.ltrim(digits, F.lit("0"))
    value = F.conv(F.when(bare == "", "0").otherwise(bare), base, 10).cast("bigint")
    return F.when(F.length(bare) > 8, F.lit(0x110000)).otherwise(value)


def _decoded(reference: Column, closed: bool) -> Column:
    name = F.substring(reference, 2, 40)
    digits = F.regexp_extract(reference, r"^&#[xX]?([0-9a-fA-F]+);?$", 1)
    hexadecimal = F.lower(F.substring(reference, 3, 1)) == "x"
    number = F.when(hexadecimal, _number(digits, 16)).otherwise(_number(digits, 10))
    named = _table(html5)
    if closed:
        return F.when(F.startswith(reference, F.lit("&#")), _code_point(number)).otherwise(
            F.coalesce(F.try_element_at(named, name), reference))
    # Names that need no ";" also count at the start of a longer word, the longest first.
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    start = F.get(F.filter(F.from_json(F.lit(json.dumps(bare)), "array<string>"), lambda n: F.startswith(name, n)), F.lit(0))
    return (F.when(F.startswith(reference, F.lit("&#")), _code_point(number))
            .otherwise(F.coalesce(F.try_element_at(named, name), F.concat(
                F.try_element_at(named, start), F.substr(name, F.length(start) + 1)), reference)))


def unescape(col: Column, closed: bool = False) -> Column:
    """Decode HTML character references once, from left to right, as browsers do.

    With ``closed`` only references that end with ";" count; cut ones stay as they are.
    """
    pattern = _CLOSED if closed else _REFERENCE
    between = F.split(col, pattern, -1)
    found = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    decoded = F.zip_with(between, found, lambda text, ref: F.concat(
        text, F.when(ref.isNull(), F.lit("")).otherwise(_decoded(ref, closed))))
    return F.when(F.contains(col, F.lit("&")), F.array_join(decoded, "")).otherwise(col)


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]*>", "")


def collapse_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, _SPACE, " "))


def clean_text(col: Column, closed: bool = False) -> Column:
    """Unescape (``closed`` as in :func:`unescape`), strip tags, collapse whitespace, trim; null becomes ''."""
    return collapse_space(strip_tags(unescape(F.coalesce(col.cast("string"), F.lit("")), closed)))


def squeeze(col: Column) -> Column:
    """Remove all whitespace; null becomes '' (spreadsheet cells)."""
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), _SPACE, "")


def first_nonempty(*cols: Column) -> Column:
    """First value that is not null, '' or '-', trimmed."""
    kept = [F.when(~c.cast("string").isin("", "-"), F.trim(c.cast("string"))) for c in cols]
    return F.coalesce(*kept)


def unwrap_jsonp(col: Column) -> Column:
    """The JSON inside ``callback( … );``; plain JSON passes unchanged."""
    body = F.trim(col)
    inner = F.regexp_extract(body, r"(?s)^[^(]+\((.*)\)\s*;?$", 1)
    return F.when(inner != "", inner).otherwise(body)
