"""Secondary control: a supplier's adjustment factors against the official chain."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgate.functions.classify import dividend_class
from pitgate.operators.actions import ACTION_KEY
from pitgate.operators.blocks import scattered
from pitgate.operators.checks import beside, gather, key_text, violations
from pitgate.operators.joins import first_match, remap_identity
from pitgate.schema import SECURITY, Rules

TINY = 1e-18
MATCHED, MISMATCH, UNOBSERVED = "MATCHED", "MISMATCH", "UNOBSERVED"
TINY_UNOBSERVED, NOT_COVERED = "TINY_UNOBSERVED", "NOT_COVERED"


def covered_factors(factors: DataFrame, transitions: DataFrame, rules: Rules) -> DataFrame:
    """Factor rows of the coverage under the code of their day, with ``remapped``."""
    rows = factors.where(F.col("effective_date").between(
        F.lit(rules.coverage_start), F.lit(rules.coverage_end)))
    return remap_identity(rows, transitions, "effective_date", rules).drop("source_code")


def factor_changes(factors: DataFrame, rules: Rules) -> DataFrame:
    """Ratio of each usable factor row to the one before, with ``is_rebase`` and ``is_change``.

    A security has at most one factor row a day, so the calendar bounds the window.
    """
    fore, back = (F.col(c).cast("double") for c in ("fore_adjust_factor", "back_adjust_factor"))
    usable = factors.where((fore > 0) & (back > 0)).select(
        *SECURITY, F.col("effective_date").alias("change_date"), fore.alias("_f"), back.alias("_b"))
    order = Window.partitionBy(*SECURITY).orderBy("change_date")
    linked = usable.withColumn("_p", F.lag(F.struct("_f", "_b")).over(order))
    ratios = linked.where("_p is not null").select(
        *SECURITY, "change_date", (F.col("_f") / F.col("_p._f")).alias("fore_ratio"),
        (F.col("_b") / F.col("_p._b")).alias("back_ratio"))
    return _classed(ratios, rules)


def _classed(ratios: DataFrame, rules: Rules) -> DataFrame:
    """Ratios with ``ratio_gap``, ``is_rebase`` and ``is_change``."""
    gap = F.abs(F.col("fore_ratio") - F.col("back_ratio")) / F.greatest(
        F.abs("fore_ratio"), F.abs("back_ratio"), F.lit(TINY))
    moved = lambda c: F.abs(F.col(c) - 1) > rules.factor_change
    return ratios.withColumn("ratio_gap", gap).withColumns({
        "is_rebase": (F.col("ratio_gap") > rules.rebase_gap) | (moved("fore_ratio") & ~moved("back_ratio")),
        "is_change": moved("back_ratio")})


CHANGE, ACTION, FAULT = 0, 1, 2
_EVENTS = "exchange string, code string, role int, day int, kind string, value double, other double, reach boolean"
_SWEPT = f"{_EVENTS}, met_day int, met_value double"


def _sweep(events: DataFrame, days: int) -> DataFrame:
    """Events with what they met: an action the change it takes, a change the action that took it.

    ``events`` are as :data:`_EVENTS` says, with days as numbers; only those in ``reach`` meet. A change comes up
    ``days`` before its day and goes when no action to come can reach it, so what is held is the changes within
    ``days`` of one day, whatever a security brings. Each action, in day order, takes the nearest free change,
    then the closest in value, then the earliest.
    """
    up = F.when(F.col("reach") & (F.col("role") == CHANGE), F.col("day") - days).otherwise(F.col("day"))
    names = [*events.columns, "met_day", "met_value"]

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        security: tuple | None = None
        free: deque[tuple] = deque()
        shape = pa.schema([("exchange", pa.string()), ("code", pa.string()), ("role", pa.int32()), ("day", pa.int32()),
                           ("kind", pa.string()), ("value", pa.float64()), ("other", pa.float64()), ("reach", pa.bool_()),
                           ("met_day", pa.int32()), ("met_value", pa.float64())])
        done: list[tuple] = []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                at, row = row[-1], row[:-1]
                _, _, role, day, _, value, _, reach = row
                if row[:2] != security:
                    done += [(*c, None, None) for c in free]
                    security, free = row[:2], deque()
                while reach and free and free[0][3] < at - days:
                    done.append((*free.popleft(), None, None))
                if reach and role == CHANGE:
                    free.append(row)
                    continue
                best = None
                if reach and free:
                    best = min(free, key=lambda c: (abs(c[3] - day), 0.0 if value is None else abs(c[5] - value), c[3]))
                    free.remove(best)
                    done.append((*best, day, value))
                done.append((*row, *((best[3], best[5]) if best else (None, None))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], f.type) for i, f in enumerate(shape)], schema=shape)
            done = []
        if free:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*c, None, None), strict=True)) for c in free], schema=shape)

    placed = events.withColumn("_up", up).repartition(*SECURITY)
    return placed.sortWithinPartitions(*SECURITY, "_up", "role").mapInArrow(swept, _SWEPT)


def _event(rows: DataFrame, role: int, day: str, value: Column, other: Column | None = None,
           kind: Column | None = None, reach: Column | None = None) -> DataFrame:
    """Rows as :data:`_EVENTS` says."""
    none = F.lit(None)
    return rows.select(
        *SECURITY, F.lit(role).alias("role"), F.unix_date(day).alias("day"),
        (none if kind is None else kind).cast("string").alias("kind"), value.cast("double").alias("value"),
        (none if other is None else other).cast("double").alias("other"),
        (F.lit(True) if reach is None else reach).alias("reach"))


def _day(days: str) -> Column:
    return F.date_from_unix_date(F.col(days))


def greedy_match(actions: DataFrame, changes: DataFrame, days: int) -> DataFrame:
    """Give every action, in day order, the best change still free within ``days``: ``exchange, code, ex_date,
    change_date, observed, distance``, null where none is left.

    ``actions``: exchange, code, ex_date, theory. ``changes``: exchange, code, change_date,
    observed. Both are unique per key and day.
    """
    events = _event(actions, ACTION, "ex_date", F.col("theory")).unionByName(
        _event(changes, CHANGE, "change_date", F.col("observed")))
    met = _sweep(events, days).where(F.col("role") == ACTION)
    return met.select(*SECURITY, _day("day").alias("ex_date"), _day("met_day").alias("change_date"),
                      F.col("met_value").alias("observed"), F.abs(F.col("met_day") - F.col("day")).alias("distance"))


def tagged_control(chain: DataFrame, factors: DataFrame, transitions: DataFrame, rules: Rules) -> DataFrame:
    """Actions, factor changes and doubled rows as one frame, for the consumer to store and split
    (:func:`control_actions`, :func:`control_changes`, :func:`control_faults`).

    Two shuffles carry the rows: copies of a security's day become one in an aggregation that combines first,
    then ranges, ratios and the sweep share the rows by security. The calendar bounds what a security brings there.
    """
    factor = F.struct(F.lit(None).cast("string").alias("kind"), F.col("back_adjust_factor").cast("double").alias("value"),
                      F.col("fore_adjust_factor").cast("double").alias("other"))
    action = F.struct(F.col("action_type").alias("kind"), F.col("back_adjust_multiplier").cast("double").alias("value"),
                      F.lit(None).cast("double").alias("other"))
    both = covered_factors(factors, transitions, rules).select(
        *SECURITY, F.lit(CHANGE).alias("role"), F.unix_date("effective_date").alias("day"), factor.alias("row")).unionByName(
            chain.select(*SECURITY, F.lit(ACTION).alias("role"), F.unix_date("ex_date").alias("day"), action.alias("row")))
    once = both.groupBy(*SECURITY, "role", "day").agg(F.count(F.lit(1)).alias("n"), F.any_value("row").alias("row"))
    here = Window.partitionBy(*SECURITY)
    single = F.col("n") == 1
    rated = single & (F.col("role") == CHANGE)
    usable = rated & (F.col("row.value") > 0) & (F.col("row.other") > 0)
    earlier = here.orderBy("role", "day").rowsBetween(Window.unboundedPreceding, -1)
    linked = once.withColumn("_p", F.last(F.when(usable, F.col("row")), ignorenulls=True).over(earlier)).withColumns({
        "_first": F.min(F.when(rated, F.col("day"))).over(here), "_last": F.max(F.when(rated, F.col("day"))).over(here)})
    acting = F.col("role") == ACTION
    known = F.col("exchange").isNotNull() & F.col("code").isNotNull()
    back, fore = F.col("row.value") / F.col("_p.value"), F.col("row.other") / F.col("_p.other")
    events = linked.where(~single | acting | (usable & F.col("_p").isNotNull())).select(
        *SECURITY, F.when(single, F.col("role")).otherwise(FAULT).alias("role"), "day",
        F.when(single, F.col("row.kind")).when(acting, "action listed twice").otherwise("two factor rows of one day").alias("kind"),
        F.when(~single, F.col("n").cast("double")).when(acting, F.col("row.value")).otherwise(back).alias("value"),
        F.when(single & ~acting, fore).alias("other"),
        F.coalesce(single & F.when(acting, known & (F.col("day") > F.col("_first")) & (F.col("day") <= F.col("_last"))).otherwise(
            known & (F.abs(back - 1) > rules.factor_change)), F.lit(False)).alias("reach"))
    return _sweep(events, rules.match_days)


def control_actions(tagged: DataFrame, rules: Rules) -> DataFrame:
    """Every official action with the change it took and its status."""
    judged = tagged.where(F.col("role") == ACTION).select(
        *SECURITY, _day("day").alias("ex_date"), F.col("kind").alias("action_type"), F.col("value").alias("theory"),
        _day("met_day").alias("change_date"), F.col("met_value").alias("observed"),
        F.abs(F.col("met_day") - F.col("day")).alias("distance"), F.col("reach").alias("covered"))
    error = F.abs(F.col("observed") - F.col("theory")) / F.greatest(F.abs("theory"), F.lit(TINY))
    status = (
        F.when(~F.col("covered"), NOT_COVERED)
        .when(F.col("change_date").isNull() & (F.abs(F.col("theory") - 1) <= rules.tiny_unobserved),
              TINY_UNOBSERVED)
        .when(F.col("change_date").isNull(), UNOBSERVED)
        .when(F.col("relative_error") > rules.factor_mismatch, MISMATCH)
        .otherwise(MATCHED))
    return judged.withColumn("relative_error", error).withColumn("status", status).drop("covered")


def control_changes(tagged: DataFrame, rules: Rules) -> DataFrame:
    """Every factor change with ``is_rebase`` and, when no action took it, ``supplier_only``."""
    changes = tagged.where(F.col("role") == CHANGE).select(
        *SECURITY, _day("day").alias("change_date"), F.col("other").alias("fore_ratio"), F.col("value").alias("back_ratio"),
        F.col("met_day").isNull().alias("_free"))
    return _classed(changes, rules).withColumn("supplier_only", F.col("is_change") & F.col("_free")).drop("_free")


def control_faults(tagged: DataFrame, rules: Rules) -> DataFrame:
    doubled = tagged.where(F.col("role") == FAULT).withColumn("_day", _day("day")).select(
        F.col("kind").alias("check"), key_text(*SECURITY, "_day").alias("key"), F.col("value").cast("long").cast("string").alias("detail"))
    off = control_actions(tagged, rules).where(F.col("status") == MISMATCH)
    return gather(violations(off, "factor ratio mismatch", key_text(*ACTION_KEY), F.col("change_date")), doubled)


def factor_control(chain: DataFrame, factors: DataFrame, transitions: DataFrame,
                   rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(actions, changes, violations)``: :func:`tagged_control`, split.

    A comparable factor that differs by more than the tolerance is a violation; so are a day with two factor
    rows of one security (after the remap) and an action that is there twice, which take no part: changes are
    told apart by their day, and days bound every group.
    """
    tagged = tagged_control(chain, factors, transitions, rules)
    return control_actions(tagged, rules), control_changes(tagged, rules), control_faults(tagged, rules)


def control_counts(actions: DataFrame, changes: DataFrame) -> DataFrame:
    """The run's counts in one row."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    a = actions.agg(
        F.count(F.lit(1)).alias("actions"), is_(MATCHED).alias("matched"), is_(MISMATCH).alias("mismatches"),
        is_(UNOBSERVED).alias("unobserved"), is_(TINY_UNOBSERVED).alias("tiny_unobserved"),
        is_(NOT_COVERED).alias("not_covered"))
    c = changes.agg(
        F.count_if("is_rebase").alias("rebases"), F.count_if("supplier_only").alias("supplier_only"))
    return beside(a, c)


def factor_events(factors: DataFrame, dividends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supplier factor rows with the first dividend record of the same day, and its class.

    ``factors``: exchange, code, effective_date and the three factors. ``dividends``:
    exchange, code, operate_date, seq, cash_ps_before_tax, stock_ps, reserve_to_stock_ps,
    event_detail.
    """
    details = ("cash_ps_before_tax", "stock_ps", "reserve_to_stock_ps", "event_detail")
    right = dividends.withColumnRenamed("operate_date", "effective_date")
    # Few bytes hold many ordered factor rows, and merged partitions would bring them all to one task.
    dealt = scattered(factors, *SECURITY, "effective_date")
    joined = first_match(dealt, right, [*SECURITY, "effective_date"], ["seq"], details)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = dividend_class(zero("cash_ps_before_tax"), zero("stock_ps"), zero("reserve_to_stock_ps"))
    events = joined.withColumns({
        "event_type": F.when(F.col("matched"), kind).otherwise("UNMATCHED_FACTOR_EVENT"),
        "evidence": F.concat(F.lit("BAOSTOCK_ADJUST_FACTOR"),
                             F.when(F.col("matched"), "+DIVIDEND_DETAIL").otherwise(""))})
    key = key_text(*SECURITY, "effective_date")
    positive = F.least("fore_adjust_factor", "back_adjust_factor", "adjust_factor") > 0
    bad = gather(
        violations(events.where(~F.col("matched")), "unmatched factor event", key),
        violations(events.where(~F.coalesce(positive, F.lit(False))), "nonpositive factor", key))
    return events.drop("matched"), bad
