"""Aggregations: conflicts, evidence, digests, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE_DIGITS = 15


def non_zero(col: Column) -> Column:
    return F.when(col != 0, col)


def unique_value(col: Column, where: Column | None = None) -> Column:
    """The largest non-zero value (zero if there is none); see :func:`has_conflict`."""
    kept = non_zero(col) if where is None else F.when(where, non_zero(col))
    return F.coalesce(F.max(kept), F.lit(0)).cast("decimal(18,6)")


def has_conflict(col: Column, where: Column | None = None) -> Column:
    """Whether a group holds two different non-zero values.

    Comparing the extremes decides it; no set of values is gathered.
    """
    kept = non_zero(col) if where is None else F.when(where, non_zero(col))
    return F.coalesce(F.min(kept) != F.max(kept), F.lit(False))


def component_profile(col: Column, where: Column, name: str) -> list[Column]:
    """Presence, conflict and target of one component among the rows of ``where``."""
    return [
        (F.count_if(where) > 0).alias(f"{name}_present"),
        has_conflict(col, where).alias(f"{name}_differential"),
        unique_value(col, where).alias(f"{name}_target"),
    ]


def dedupe(rows: DataFrame, identity: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per identity: the first by ``order``, else the smallest.

    Long text in the identity takes part as a digest, so the shuffle key stays short.
    """
    rest = [c for c in rows.columns if c not in identity]
    if not rest:
        return rows.distinct()
    row = F.struct(*rest)
    first = F.min_by(row, F.struct(*order)) if order else F.min(row)
    once = rows.groupBy(*identity).agg(first.alias("_row"))
    return once.select(
        *[F.col(c) if c in identity else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


def evidence_union(first: DataFrame, second: DataFrame, keys: Sequence[str],
                   identity: Sequence[str]) -> DataFrame:
    """Evidence of both sides, once per identity, the first side's copy winning.

    Evidence stays one row per item (key, rank of the side, identity), so a key with very
    many items never becomes one value.
    """
    cols = [*keys, *identity]
    rest = [c for c in first.columns if c not in cols]
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    row = F.min(F.struct("_side", *rest)).alias("_row")
    return both.groupBy(*cols).agg(row).select(
        *[F.col(c) if c in cols else F.col(f"_row.`{c}`").alias(c) for c in first.columns])


def _lane(digest: Column, i: int) -> Column:
    part = F.substring(digest, 1 + i * LANE_DIGITS, LANE_DIGITS)
    return F.conv(part, 16, 10).cast("decimal(28,0)")


def content_digest(line: Column, lanes: int = 4) -> Column:
    """Digest of a multiset of text lines, whatever their order and partitioning.

    Sums of four 60-bit parts of each line's SHA-256 with the count, hashed: it combines
    before the shuffle, so a dataset of any size is digested without sorting it. The sums have
    38 digits, room for 10**19 lines.
    """
    digest = F.sha2(line, 256)
    sums = [F.coalesce(F.sum(_lane(digest, i)), F.lit(0)).cast("string") for i in range(lanes)]
    return F.sha2(F.concat_ws(":", F.count(line).cast("string"), *sums), 256)


def manifest_fingerprint(line: Column) -> Column:
    """SHA-256 over the sorted manifest lines.

    For manifests (a line per venue and year, or per file), whose length the calendar or
    the file list bounds; rows of data go through :func:`content_digest`.
    """
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)


def completeness(found: DataFrame, shard: str, declared: str) -> DataFrame:
    """Whether shard numbers are exactly 0 … n-1 for the one declared n."""
    return found.agg(
        F.count_distinct(shard).alias("shards_found"),
        F.min(declared).alias("declared"),
        (F.min(declared) == F.max(declared)).alias("declared_once"),
        ((F.min(shard) == 0) & (F.max(shard) == F.min(declared) - 1)
         & (F.count_distinct(shard) == F.min(declared))
         & (F.min(declared) == F.max(declared))).alias("complete"),
    )


def last_page_wins(rows: DataFrame, key: Sequence[str], page: str) -> DataFrame:
    """Rows of several pages merged by key, the highest page winning."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(page)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
