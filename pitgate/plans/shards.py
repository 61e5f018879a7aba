"""Audits of tables that arrive as shards: manifests, files and rows must say the same.

A manifest is a row ``lane, shard, data_file, data_sha256, securities, rows, errors`` (errors: texts of the
source); a lane is what one run of a source delivered. The actual files come from
``sources.files.digests`` (one pass over bytes), the actual rows as counts by shard (one pass over rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgate.operators.actions import ACTION_KEY
from pitgate.operators.aggregates import content_digest, manifest_fingerprint
from pitgate.operators.checks import beside, duplicate_keys, gather, key_text, row_violations, violations
from pitgate.operators.joins import missing_keys, set_sides
from pitgate.schema import SECURITY

MANIFEST = ("lane string, shard int, data_file string, data_sha256 string, securities bigint, rows bigint, "
            "errors array<string>")
SHARD = ["lane", "shard"]


@dataclass(frozen=True)
class Lane:
    """What a lane must deliver: so many shards, for the universe or one venue of it.

    An ``optional`` lane may be absent as a whole; one that is not ``queried`` by security declares none.
    """

    name: str
    shards: int
    venue: str | None = None
    optional: bool = False
    queried: bool = True


def _lanes(df: DataFrame, lanes: Sequence[Lane]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(x.name, x.shards, x.venue, x.optional, x.queried) for x in lanes],
        "lane string, shards int, venue string, optional boolean, queried boolean")


def shard_violations(manifests: DataFrame, files: DataFrame, lanes: Sequence[Lane]) -> DataFrame:
    """Lanes whose shards are not exactly 0 … n-1, errors of the source, and files that are absent, altered or of
    no shard. ``files``: file, sha256."""
    found = manifests.groupBy("lane").agg(
        F.count_distinct("shard").alias("n"), F.min("shard").alias("lowest"), F.max("shard").alias("highest"))
    told = _lanes(manifests, lanes).join(found, "lane", "full_outer")
    whole = (F.col("n") == F.col("shards")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("shards") - 1)
    count = F.concat_ws(" of ", F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.col("shards").cast("string"))
    held = manifests.select(*SHARD, F.col("data_file").alias("file"), "data_sha256").join(
        files.select("file", F.col("sha256").alias("actual")), "file", "full_outer")
    listed, present = F.col("lane").isNotNull(), F.col("actual").isNotNull()
    return gather(
        row_violations(told, F.col("lane"), {
            "unknown lane": F.col("shards").isNotNull(),
            "shards missing": F.col("shards").isNull() | whole | (F.col("optional") & F.col("n").isNull())}, count),
        violations(duplicate_keys(manifests, SHARD), "shard listed twice", key_text(*SHARD), F.col("n")),
        violations(manifests.select(*SHARD, F.explode("errors").alias("e")), "source error", key_text(*SHARD), F.col("e")),
        row_violations(held, F.concat_ws(":", "lane", F.col("shard").cast("string"), "file"), {
            "shard file missing": ~listed | present,
            "shard file digest differs": ~listed | ~present | (F.col("data_sha256") == F.col("actual")),
            "file of no shard": listed}))


def count_violations(manifests: DataFrame, found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Declared counts that the rows do not bear out. ``found``: lane, shard and the counts."""
    declared = manifests.select(*SHARD, *[F.col(n).alias(f"_{n}") for n in names])
    both = declared.join(found.select(*SHARD, *names), SHARD, "full_outer")
    off = F.array_compact(F.array(*[
        F.when(~F.coalesce(f"_{n}", F.lit(0)).eqNullSafe(F.coalesce(n, F.lit(0))),
               F.concat_ws(" ", F.lit(n), F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("string"), F.lit("<>"),
                           F.coalesce(F.col(n), F.lit(0)).cast("string"))) for n in names]))
    return violations(both.select(*SHARD, F.explode(off).alias("d")), "declared and found counts differ",
                      key_text(*SHARD), F.col("d"))


def queried_violations(manifests: DataFrame, universe: DataFrame, lanes: Sequence[Lane]) -> DataFrame:
    """Queried lanes that did not ask for as many securities as the universe, or its venue, has."""
    of = F.explode(F.array(F.col("exchange"), F.lit("")))  # a security counts for its venue and for the whole
    sizes = universe.select(*SECURITY).distinct().select(of.alias("venue")).groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    wanted = (_lanes(manifests, lanes).where("queried").withColumn("venue", F.coalesce("venue", F.lit("")))
              .join(sizes, "venue", "left").select("lane", "optional", F.coalesce("n", F.lit(0)).alias("wanted")))
    asked = manifests.groupBy("lane").agg(F.sum("securities").alias("asked"))
    both = wanted.join(asked, "lane", "left")
    off = ~F.col("asked").eqNullSafe(F.col("wanted")) & ~(F.col("optional") & F.col("asked").isNull())
    return violations(both.where(off), "queried securities and universe differ", F.col("lane"), F.concat_ws(
        " <> ", F.coalesce("asked", F.lit(0)).cast("string"), F.col("wanted").cast("string")))


def shards_fingerprint(files: DataFrame, line: Column, rows: DataFrame) -> DataFrame:
    """One row ``fingerprint`` of the files by name and the multiset of ``rows`` as the text ``line``."""
    named = files.agg(manifest_fingerprint(F.concat_ws(":", "file", "sha256")).alias("a"))
    return beside(named, rows.agg(content_digest(line).alias("b"))).select(
        F.sha2(F.concat_ws("\n", "a", "b"), 256).alias("fingerprint"))


def state_counts_by_shard(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(by shard, by shard and security)``: rows and kinds of days, both from one combining aggregation."""
    each = state.groupBy(*SHARD, *SECURITY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("tradable").alias("tradable"),
        F.count_if(~F.col("tradable")).alias("suspended"), F.count_if("risk_warning").alias("risk_warning"))
    kinds = ["rows", "tradable", "suspended", "risk_warning"]
    return each.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("securities"), *[F.sum(n).alias(n) for n in kinds]), each


def state_shards_gate(manifests: DataFrame, files: DataFrame, sources: DataFrame, state: DataFrame, universe: DataFrame,
                      declared_relisting: DataFrame, relisting: DataFrame, shards: int = 16) -> DataFrame:
    """The shards of the daily state beside their manifests; what the rows themselves must obey is ``state_gate``.

    ``manifests`` also declare tradable, suspended and risk_warning. ``sources``: lane, shard, exchange, code, rows,
    sha256 of every source answer. ``state`` carries lane and shard of its file. ``declared_relisting`` is
    what the manifests say of relisting days, ``relisting`` the official list.
    """
    lanes = [Lane("STATE", shards)]
    by_shard, each = state_counts_by_shard(state)
    got = sources.join(each.select(*SHARD, *SECURITY, F.col("rows").alias("state_rows")), [*SHARD, *SECURITY], "full_outer")
    key = key_text(*SECURITY)
    listed = F.col("rows").isNotNull()
    sides = set_sides(universe, sources, SECURITY)
    day = [*SECURITY, "trade_date"]
    days = set_sides(declared_relisting, relisting, day)
    return gather(
        shard_violations(manifests, files, lanes),
        count_violations(manifests, by_shard, ["securities", "rows", "tradable", "suspended", "risk_warning"]),
        queried_violations(manifests, universe, lanes),
        violations(duplicate_keys(sources, SECURITY), "security in several shards", key, F.col("n")),
        row_violations(got, key, {
            "rows of no source": listed,
            "source hash missing": ~listed | (F.length(F.coalesce("sha256", F.lit(""))) > 0),
            "source without rows": ~listed | F.col("state_rows").isNotNull(),
            "source rows differ from state rows": ~listed | F.col("state_rows").isNull() | (F.col("rows") == F.col("state_rows"))}),
        violations(sides.where("not in_right"), "security of no source", key),
        violations(sides.where("not in_left"), "source outside the universe", key),
        violations(days.where("not in_right"), "relisting day that is not on the list", key_text(*day)),
        violations(days.where("not in_left"), "relisting day that no manifest has", key_text(*day)))


def ledger_gate(manifests: DataFrame, files: DataFrame, primary: DataFrame, control: DataFrame, universe: DataFrame,
                ledger: DataFrame, faults: DataFrame, lanes: Sequence[Lane]) -> DataFrame:
    """The action ledger beside the shards it was made of.

    ``primary``: component rows with lane and shard; ``control``: the venue's own rows, which the ledger must not
    lack; ``universe``: the securities to ask for, free of aliases; ``ledger`` and ``faults``: what
    ``ledger_stage`` gave.
    """
    counted = primary.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("rows"))
    native = control.where(F.col("action_component") != "RIGHTS").select(*ACTION_KEY).distinct()
    return gather(
        shard_violations(manifests, files, lanes),
        count_violations(manifests, counted, ["rows"]),
        queried_violations(manifests, universe, lanes),
        violations(missing_keys(native, ledger, ACTION_KEY), "native event missing from the ledger", key_text(*ACTION_KEY)),
        violations(duplicate_keys(ledger, ACTION_KEY), "action listed twice", key_text(*ACTION_KEY), F.col("n")),
        violations(ledger.where(F.coalesce("action_type", F.lit("")) == ""), "action without amounts", key_text(*ACTION_KEY)),
        faults)
