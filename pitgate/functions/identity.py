"""Codes, digests and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def six_digits(code: Column) -> Column:
    return code.rlike("^[0-9]{6}$")


def is_sse_main_code(code: Column) -> Column:
    return code.rlike("^6[0-9]{5}$") & ~code.rlike("^68[89]")


def in_scope(exchange: Column, code: Column) -> Column:
    """Whether a code belongs to the main boards of its venue."""
    number = code.try_cast("int")
    sse = six_digits(code) & ~code.rlike("^68[89]")
    szse = six_digits(code) & number.between(1, 4999) & ~number.between(1001, 1199)
    return F.when(exchange == "SSE", sse).when(exchange == "SZSE", szse).otherwise(F.lit(False))


def supplier_code(exchange: Column, code: Column) -> Column:
    return F.concat(F.when(exchange == "SSE", F.lit("sh.")).otherwise(F.lit("sz.")), code)


def row_digest(payload: Column) -> Column:
    return F.sha2(payload.cast("string"), 256)


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON of a row with keys in alphabetic order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_map(entries: Column) -> Column:
    """JSON of a string map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def compact_key(exchange: Column, code: Column, day: Column) -> Column:
    """One 64-bit number per (venue, six-digit code, day); null for a code that is no number.

    The day part counts days from 0001-01-01 as 1.
    """
    venue = F.shiftleft(F.when(exchange == "SZSE", F.lit(1)).otherwise(F.lit(0)).cast("bigint"), 50)
    number = F.shiftleft(code.try_cast("bigint"), 20)
    ordinal = (F.unix_date(day) + F.lit(719163)).cast("bigint")
    return venue.bitwiseOR(number).bitwiseOR(ordinal)


def tag_evidence(evidence: Column, tag: str) -> Column:
    return F.concat(evidence, F.lit(f"+{tag}"))


def well_formed_sha256(digest: Column) -> Column:
    return F.coalesce(digest, F.lit("")).rlike("^[0-9a-f]{64}$")
