"""Whole stages: the operators in the order a dataset is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgate.operators import actions as ac
from pitgate.operators import bars as br
from pitgate.operators import lifecycle as lc
from pitgate.operators.checks import gather
from pitgate.operators.joins import remap_identity
from pitgate.schema import Rules


def lifecycle_stage(events: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals by the code of their day, from events and code changes."""
    valid, bad_events = lc.validate_events(events)
    changes, bad_changes = lc.validate_transitions(transitions)
    base, faults = lc.build_intervals(valid)
    intervals, bad_overlay = lc.apply_transitions(base, changes)
    return intervals, gather(bad_events, bad_changes, faults, bad_overlay)


def bars_stage(payloads: DataFrame, day_tables: DataFrame, life: DataFrame,
               rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars of both venues in one table, unique per security and day."""
    nested, bad_payloads = br.explode_array_payload(payloads)
    first, bad_first, seen_first = br.normalize_bars(nested, life, rules)
    tabular, bad_days = br.day_table_rows(day_tables)
    second, bad_second, seen_second = br.normalize_bars(
        tabular, life, rules, unit=br.TEN_THOUSAND, outside="ignore")
    bars, doubled = br.unique_bars(first.unionByName(second))
    found = gather(bad_payloads, bad_first, bad_days, bad_second, doubled)
    return bars, found, seen_first.unionByName(seen_second)


def ledger_stage(primary: DataFrame, control: DataFrame, life: DataFrame, transitions: DataFrame,
                 rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The action ledger after code-time remap, merge and the venue's own control.

    The control's rights rows are primary evidence; its other rows reconcile components.
    """
    native_rights = control.where(F.col("action_component") == "RIGHTS")
    rows = remap_identity(primary.unionByName(native_rights), transitions, "ex_date", rules)
    rows = rows.drop("source_code", "remapped")
    ledger, faults = ac.merge_components(rows)
    reconciled = ac.reconcile_control(
        ledger, ac.aggregate_control(control), ac.declared_differentials(rows), rules)
    counted = reconciled.join(ac.added_evidence(rows, control), list(ac.ACTION_KEY), "left")
    total = F.col("source_count") + F.when(F.col("checked"), F.coalesce("added", F.lit(0))).otherwise(F.lit(0))
    found = gather(ac.lifecycle_violations(rows, life, rules), faults, ac.reconciliation_violations(reconciled))
    return counted.withColumn("source_count", total).drop("added"), found
