"""Joins in time: lives, code changes, near days, set reconciliation, overlays.

No join here has a broadcast hint: the dimension sides (securities, code changes,
overrides) are small in practice, and Spark broadcasts them when their measured size is
under its threshold. Past it they shuffle on key *and* year slice, so that one busy
security spreads over the years of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgate.functions.dates import active_on
from pitgate.schema import SECURITY, Rules

SLICE = "_slice"


def _clamp(year: Column, rules: Rules) -> Column:
    """A year inside the coverage; days outside share its first or last slice."""
    lo, hi = rules.coverage_start.year, rules.coverage_end.year
    return F.greatest(F.lit(lo), F.least(F.lit(hi), year))


def day_slice(day: str, rules: Rules) -> Column:
    return _clamp(F.year(day), rules)


def _all_slices(rules: Rules) -> Column:
    return F.explode(F.sequence(F.lit(rules.coverage_start.year), F.lit(rules.coverage_end.year)))


def interval_join(fact: DataFrame, life: DataFrame, day: str, rules: Rules,
                  keys: Sequence[str] = SECURITY, start: str = "listed_from",
                  end: str = "listed_to_exclusive") -> DataFrame:
    """Facts with the interval (half-open) that holds their day; others are dropped."""
    first = _clamp(F.year(start), rules)
    last = _clamp(F.coalesce(F.year(end), F.lit(rules.coverage_end.year)), rules)
    spread = life.withColumn(SLICE, F.explode(F.sequence(first, F.greatest(first, last))))
    facts = fact.withColumn(SLICE, day_slice(day, rules))
    joined = facts.join(spread, [*keys, SLICE])
    return joined.where(active_on(F.col(start), F.col(end), F.col(day))).drop(SLICE)


def lifecycle_status(fact: DataFrame, life: DataFrame, day: str, rules: Rules,
                     keys: Sequence[str] = SECURITY, start: str = "listed_from",
                     end: str = "listed_to_exclusive", extra: Sequence[str] = (),
                     keep_slice: bool = False) -> DataFrame:
    """Facts with INSIDE, OUTSIDE_LIFECYCLE or OUT_OF_UNIVERSE, and the life's dates.

    ``life`` holds one interval per key; ``extra`` of its columns come along. With
    ``keep_slice`` the slice column stays, for steps that go on by (key, slice).
    """
    spread = life.select(*keys, start, end, *extra).withColumn(SLICE, _all_slices(rules))
    facts = fact.withColumn(SLICE, day_slice(day, rules))
    status = (
        F.when(F.col(start).isNull(), "OUT_OF_UNIVERSE")
        .when(active_on(F.col(start), F.col(end), F.col(day)), "INSIDE")
        .otherwise("OUTSIDE_LIFECYCLE")
    )
    joined = facts.join(spread, [*keys, SLICE], "left").withColumn("lifecycle_status", status)
    return joined if keep_slice else joined.drop(SLICE)


def slices_between(first: str, last: str, rules: Rules) -> Column:
    """The slices that the days ``first`` … ``last`` touch, one row each."""
    return F.explode(F.sequence(_clamp(F.year(first), rules), _clamp(F.year(last), rules)))


def remap_identity(rows: DataFrame, transitions: DataFrame, day: str, rules: Rules) -> DataFrame:
    """Rows dated before a code change under the old code, with ``remapped`` and ``source_code``."""
    changes = transitions.select(
        "exchange", F.col("new_code").alias("code"), F.col("old_code").alias("_old"),
        F.col("effective_date").alias("_eff"),
    )
    first = F.lit(rules.coverage_start.year)
    spread = changes.withColumn(
        SLICE, F.explode(F.sequence(first, _clamp(F.year("_eff"), rules))))
    facts = rows.withColumn(SLICE, day_slice(day, rules))
    joined = facts.join(spread, ["exchange", "code", SLICE], "left").drop(SLICE)
    moved = F.coalesce(F.col(day) < F.col("_eff"), F.lit(False))
    out = (joined.withColumn("source_code", F.col("code"))
           .withColumn("remapped", moved)
           .withColumn("code", F.when(moved, F.col("_old")).otherwise(F.col("code"))))
    return out.select(*rows.columns, "source_code", "remapped")


def near_pairs(left: DataFrame, right: DataFrame, left_day: str, right_day: str, days: int,
               keys: Sequence[str] = SECURITY) -> DataFrame:
    """Pairs of the same key at most ``days`` apart.

    Days fall into buckets of width ``days``; a left row looks into the buckets its range
    touches, so a key's rows meet only their neighbours.
    """
    def bucket(offset: int) -> Column:
        return F.floor((F.unix_date(left_day) + F.lit(offset)) / F.lit(days)).cast("int")

    a = left.withColumn(SLICE, F.explode(F.sequence(bucket(-days), bucket(days))))
    b = right.withColumn(SLICE, F.floor(F.unix_date(right_day) / F.lit(days)).cast("int"))
    joined = a.join(b, [*keys, SLICE]).drop(SLICE)
    return joined.where(F.abs(F.datediff(left_day, right_day)) <= days)


def set_sides(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key with ``in_left`` and ``in_right``: the base of all set tests.

    A union and one combining aggregation, so repeated keys never leave the map tasks.
    """
    a = left.select(*keys).withColumn("_l", F.lit(True)).withColumn("_r", F.lit(False))
    b = right.select(*keys).withColumn("_l", F.lit(False)).withColumn("_r", F.lit(True))
    return a.union(b).groupBy(*keys).agg(
        F.bool_or("_l").alias("in_left"), F.bool_or("_r").alias("in_right"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of counts: both sides, each remainder, and whether the sets are equal."""
    sides = set_sides(left, right, keys)
    return sides.agg(
        F.count_if("in_left").alias("primary_count"),
        F.count_if("in_right").alias("control_count"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("only_primary_count"),
        F.count_if(F.col("in_right") & ~F.col("in_left")).alias("only_control_count"),
        F.count_if(F.col("in_left") & F.col("in_right")).alias("common_count"),
        F.coalesce(F.every(F.col("in_left") == F.col("in_right")), F.lit(True)).alias("set_equal"),
    )


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return set_sides(left, right, keys).where("in_left and not in_right").select(*keys)


def intersection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return set_sides(left, right, keys).where("in_left and in_right").select(*keys)


def missing_keys(required: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required rows without a counterpart: the one-directional contract between gates."""
    return required.join(available.select(*keys), list(keys), "left_anti")


def at_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the rows at the wanted keys."""
    return rows.join(wanted.select(*keys), list(keys), "left_semi")


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str],
                values: Sequence[str]) -> DataFrame:
    """Left rows with the first right row of equal key, and ``matched``.

    The right side is cut to its first row per key while it is combined, before the join.
    """
    best = right.groupBy(*keys).agg(
        F.min_by(F.struct(*values), F.struct(*order)).alias("_m"))
    joined = left.join(best, list(keys), "left")
    return joined.select(
        *left.columns, *[F.col(f"_m.`{c}`").alias(c) for c in values],
        F.col("_m").isNotNull().alias("matched"),
    )


def overlay(rows: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace columns at the override keys; ``overridden`` marks rows that changed.

    ``overrides`` holds the keys and the replacing columns. A null there replaces too.
    """
    replaced = [c for c in overrides.columns if c not in keys]
    table = overrides.select(*keys, F.struct(*replaced).alias("_o"))
    joined = rows.join(table, list(keys), "left")
    hit = F.col("_o").isNotNull()
    changed = F.lit(False)
    for c in replaced:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_o.`{c}`"))
    values = [
        F.when(hit, F.col(f"_o.`{c}`")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c)
        for c in rows.columns
    ]
    return joined.select(*values, (hit & changed).alias("overridden"))


def override_hits(rows: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows each override meets; anything but one is a fault."""
    wanted = overrides.select(*keys).distinct()
    met = at_keys(rows, wanted, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(met, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
