"""Calendars as DataFrames; their size is that of the calendar, not of the data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgate.functions.dates import is_weekday
from pitgate.operators.blocks import scattered
from pitgate.operators.joins import set_sides
from pitgate.schema import SECURITY


def weekdays(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Monday to Friday of ``[start, end]``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return days.where(is_weekday(F.col("day")))


def venue_days(bars: DataFrame) -> DataFrame:
    """Distinct trading days per venue; one combining pass over the bars."""
    return bars.select("exchange", F.col("trade_date").alias("day")).distinct()


def calendar_mismatch(days: DataFrame, left: str, right: str) -> DataFrame:
    """Days on which only one of two venues traded."""
    a = days.where(F.col("exchange") == left)
    b = days.where(F.col("exchange") == right)
    sides = set_sides(a, b, ["day"]).where("in_left <> in_right")
    return sides.select("day", F.when(F.col("in_left"), F.lit(left)).otherwise(F.lit(right)).alias("only"))


def security_days(life: DataFrame, days: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per security and trading day of its life inside ``[start, end]``.

    Each life expands into its own days; the venue calendar, which is small whatever the data, then filters by
    equality where the days are.
    """
    first = F.greatest(F.col("listed_from"), F.lit(start))
    last = F.least(F.coalesce(F.date_sub("listed_to_exclusive", 1), F.lit(end)), F.lit(end))
    # Scattered before they grow: lives are few, and their partitions would be merged into a task or two.
    spread = scattered(life.where(first <= last), *SECURITY).withColumn("trade_date", F.explode(F.sequence(first, last)))
    open_days = days.select(F.col("day").alias("trade_date")).distinct()
    return spread.where(is_weekday(F.col("trade_date"))).join(F.broadcast(open_days), "trade_date", "left_semi")
