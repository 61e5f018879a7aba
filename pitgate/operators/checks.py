"""Rejected rows as data.

A violation is a row ``(check, key, detail)``. Transformations return the clean rows and
the violations side by side; failing closed is left to the audits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = ":"


def key_text(*names: str) -> Column:
    """A readable key from column names; nulls show as empty parts."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])


def violations(df: DataFrame, check: str, key: Column, detail: Column | str = "") -> DataFrame:
    """Every row of ``df`` as a violation of one check."""
    text = F.lit(detail) if isinstance(detail, str) else F.coalesce(detail.cast("string"), F.lit(""))
    return df.select(F.lit(check).alias("check"), key.alias("key"), text.alias("detail"))


def evaluated_once(df: DataFrame, **cols: Column) -> DataFrame:
    """The frame with more columns, each computed once a row.

    Later filters and columns that use a costly column would each repeat it, for Spark moves filters below a plain
    projection and writes its expressions out wherever they are used. It does neither with what a generator returns; the outer form, for it filters no empty arrays before.
    """
    row = F.array(F.struct(*[c.alias(name) for name, c in cols.items()]))
    made = df.withColumn("_made", row)
    return made.select(*df.columns, F.inline_outer("_made"))


def failed_checks(checks: Mapping[str, Column]) -> Column:
    """Names of the checks a row fails. A check whose condition is null fails."""
    failing = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.array_compact(F.array(*failing))


def row_violations(df: DataFrame, key: Column, checks: Mapping[str, Column],
                   detail: Column | str = "") -> DataFrame:
    """All row-level checks in one pass; a row gives one violation per failed check."""
    text = F.lit(detail) if isinstance(detail, str) else F.coalesce(detail.cast("string"), F.lit(""))
    return df.select(
        F.explode(failed_checks(checks)).alias("check"), key.alias("key"), text.alias("detail")
    )


def split_rows(df: DataFrame, key: Column, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the violations of the others."""
    tagged = df.withColumn("_failed", failed_checks(checks)).withColumn("_key", key)
    clean = tagged.where(F.size("_failed") == 0).drop("_failed", "_key")
    bad = tagged.where(F.size("_failed") > 0).select(
        F.explode("_failed").alias("check"), F.col("_key").alias("key"), F.lit("").alias("detail")
    )
    return clean, bad


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def enforce_unique(df: DataFrame, keys: Sequence[str], check: str = "duplicate key") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is unique, and one violation per duplicated key.

    One aggregation that combines before the shuffle: a key with a large share of the
    rows collapses in the map tasks, and nothing is joined back.
    """
    rest = [c for c in df.columns if c not in keys]
    payload = F.any_value(F.struct(*rest)) if rest else F.lit(None)
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), payload.alias("_row"))
    clean = once.where("_n = 1").select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)
    bad = violations(once.where("_n > 1"), check, key_text(*keys), F.col("_n"))
    return clean, bad


def gather(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def summarize(found: DataFrame, severity: str = "error") -> DataFrame:
    """Count and extreme keys per check; one combining pass whatever their number."""
    return found.groupBy("check").agg(
        F.lit(severity).alias("severity"),
        F.count(F.lit(1)).alias("n_violations"),
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
    )


def samples(found: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` keys of each check, as rows.

    The rank filter becomes a per-task limit before the shuffle, so a check with very
    many violations does not send them all to one task.
    """
    order = Window.partitionBy("check").orderBy("key", "detail")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def sorted_sample(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in order: each task keeps ``n``, the driver merges those."""
    return df.select(*cols).orderBy(*cols).limit(n)


def report(gate: str, found: DataFrame, facts: DataFrame, sample_size: int = 20,
           warnings: DataFrame | None = None) -> DataFrame:
    """A one-row audit report: facts, pass flag, and at most ``sample_size`` messages a check.

    ``facts`` is one row.
    """
    message = F.rtrim(F.format_string("%s: %s %s", "check", "key", "detail"))

    def condensed(frame: DataFrame, name: str) -> DataFrame:
        few = samples(frame, sample_size).select(F.struct("check", "rank", message.alias("text")).alias("m"))
        return few.agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["text"]).alias(name))

    parts = [facts, found.agg(F.count(F.lit(1)).alias("n_errors")), condensed(found, "errors")]
    if warnings is not None:
        parts.append(condensed(warnings, "warnings"))
    return beside(*parts).select(F.lit(gate).alias("gate"), (F.col("n_errors") == 0).alias("pass"), "*")
