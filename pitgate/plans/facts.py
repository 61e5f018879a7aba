"""Report figures as a long table, so that gates compare them with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgate.operators.checks import violations


def facts_of(report: DataFrame, prefix: str = "") -> DataFrame:
    """``(name, value)`` of every scalar column of a one-row report."""
    pairs = [
        F.struct(F.lit(prefix + f.name).alias("name"), F.col(f"`{f.name}`").cast("string").alias("value"))
        for f in report.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return report.select(F.explode(F.array(*pairs)).alias("f")).select("f.*")


def unequal_pairs(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs ``(check, left, right)`` of fact names whose values differ or are missing."""
    side = lambda name: facts.select(F.col("name").alias(name), F.col("value").alias(f"{name}_value"))
    joined = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    same = F.col("left_value") == F.col("right_value")
    shown = F.concat_ws(" <> ", F.coalesce("left_value", F.lit("missing")), F.coalesce("right_value", F.lit("missing")))
    return joined.where(~F.coalesce(same, F.lit(False))).select(
        "check", F.concat_ws("=", "left", "right").alias("key"), shown.alias("detail"))


def unmet_pins(facts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned ``(name, expected)`` figures that the facts do not meet exactly."""
    joined = pinned.join(facts, "name", "left")
    return violations(joined.where(~F.col("expected").eqNullSafe(F.col("value"))), "pinned figure not met",
                      F.col("name"), F.concat_ws(" instead of ", F.coalesce("value", F.lit("missing")), "expected"))


def below_floor(facts: DataFrame, floors: DataFrame) -> DataFrame:
    """``(name, floor)`` figures that are missing or too small."""
    joined = floors.join(facts, "name", "left")
    enough = F.col("value").try_cast("bigint") >= F.col("floor")
    return violations(joined.where(~F.coalesce(enough, F.lit(False))), "implausibly small figure",
                      F.col("name"), F.coalesce("value", F.lit("missing")))


def canonical_fingerprint(facts: DataFrame) -> DataFrame:
    """SHA-256 over the facts as one JSON object with sorted names.

    A report has a fixed number of figures, so the object is small however large the data.
    """
    entries = F.array_sort(F.collect_list(F.struct("name", "value")))
    return facts.agg(F.sha2(F.to_json(F.map_from_entries(entries)), 256).alias("fingerprint"))
