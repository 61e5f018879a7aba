"""Daily bars: both source shapes to one table, and the repair after a code change."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgate.functions.numbers import non_negative_integer, ohlc_valid, strict_decimal
from pitgate.operators.checks import enforce_unique, evaluated_once, failed_checks, gather, key_text, violations
from pitgate.operators.joins import lifecycle_status, missing_keys
from pitgate.schema import BAR, KEYS, SECURITY, Rules

# The header of the full-market day table, in its order.
DAY_TABLE_HEADER = (
    "交易日期", "证券代码", "证券简称", "前收", "开盘", "最高", "最低", "今收",
    "涨跌幅（%）", "成交量(万股)", "成交金额(万元)", "市盈率",
)
TEN_THOUSAND = 10_000
_PAYLOAD = "code STRING, begin STRING, end STRING, kline ARRAY<ARRAY<STRING>>"


def explode_array_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the nested array payload: ``(exchange, code, payload)`` in, one row per day out.

    Dates must rise strictly inside a payload; that is tested on the array itself, so no
    window and no shuffle is needed.
    """
    doc = F.from_json("payload", _PAYLOAD)
    parsed = evaluated_once(evaluated_once(payloads, _doc=doc).select(*SECURITY, "_doc"), _days=F.transform(
        "_doc.kline", lambda r: F.try_to_date(F.get(r, F.lit(0)), "yyyyMMdd")))
    steps = F.zip_with(
        F.slice("_days", 1, F.greatest(F.size("_days") - 1, F.lit(0))),
        F.slice("_days", 2, F.greatest(F.size("_days") - 1, F.lit(0))),
        lambda a, b: b > a)
    rising = F.forall(steps, lambda ok: F.coalesce(ok, F.lit(False)))
    shaped = F.forall("_doc.kline", lambda r: F.size(r) == 7)
    checked = evaluated_once(parsed, _failed=failed_checks({
        "code mismatch": F.col("_doc.code") == F.col("code"),
        "malformed kline": F.coalesce(shaped, F.lit(True)),
        "non-increasing dates": F.coalesce(rising, F.lit(True)),
    }))
    bad = checked.where(F.size("_failed") > 0).select(
        F.explode("_failed").alias("check"), key_text(*SECURITY).alias("key"), F.lit("").alias("detail"))
    items = checked.where(F.size("_failed") == 0).select(
        *SECURITY, F.posexplode("_doc.kline").alias("position", "item"))
    names = ("open", "high", "low", "close", "volume", "amount")
    rows = items.select(
        *SECURITY, "position", F.try_to_date(F.get("item", F.lit(0)), "yyyyMMdd").alias("trade_date"),
        *[F.get("item", F.lit(i)).alias(c) for i, c in enumerate(names, start=1)])
    return rows, bad


def day_table_rows(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data rows of the full-market day tables (all text, one column ``requested_day`` more).

    Placeholder rows drop out; a row of another day than the requested one is a violation.
    """
    dated = table.where(F.col(DAY_TABLE_HEADER[0]).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    rows = dated.select(
        F.lit("SZSE").alias("exchange"), F.col("证券代码").alias("code"),
        F.try_to_date(DAY_TABLE_HEADER[0], "yyyy-MM-dd").alias("trade_date"), "requested_day",
        F.col("开盘").alias("open"), F.col("最高").alias("high"), F.col("最低").alias("low"),
        F.col("今收").alias("close"), F.col("成交量(万股)").alias("volume"),
        F.col("成交金额(万元)").alias("amount"))
    same = F.coalesce(F.col("trade_date") == F.col("requested_day"), F.lit(False))
    bad = violations(rows.where(~same), "source day mismatch",
                     key_text("exchange", "code", "trade_date"), F.col("requested_day"))
    return rows.where(same).drop("requested_day"), bad


def normalize_bars(rows: DataFrame, life: DataFrame, rules: Rules, unit: int = 1,
                   outside: str = "reject") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(bars, violations, diagnostics)`` from text rows of either source.

    ``outside`` says what a row outside its security's life is: a violation ("reject"), or
    only counted ("ignore"), as in a table that holds other boards too.
    """
    covered = rows.where(F.col("trade_date").between(F.lit(rules.coverage_start), F.lit(rules.coverage_end)))
    placed = lifecycle_status(covered, life, "trade_date", rules)
    inside = F.col("lifecycle_status") == "INSIDE"
    shown = ("open", "high", "low", "close")
    kept = placed.select(*SECURITY, "trade_date", "lifecycle_status", *[F.col(c).alias(f"_{c}") for c in shown], "volume", "amount")
    typed = evaluated_once(
        kept, **{c: strict_decimal(F.col(f"_{c}")) for c in shown},
        volume_shares=non_negative_integer(F.col("volume"), unit), amount_cny=non_negative_integer(F.col("amount"), unit))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    checks: dict[str, Column] = {
        "missing price": reduce(and_, [p.isNotNull() for p in prices]),
        "OHLC invariant": ohlc_valid(*prices),
        "volume not a non-negative integer": F.col("volume_shares").isNotNull(),
        "amount not a non-negative integer": F.col("amount_cny").isNotNull(),
    }
    failed = F.when(inside, failed_checks(checks))
    if outside == "reject":
        failed = F.coalesce(failed, F.array(F.lit("outside lifecycle")))
    checked = evaluated_once(typed, _failed=failed)
    bad = checked.where(F.size("_failed") > 0).select(
        F.explode("_failed").alias("check"),
        key_text(*SECURITY, "trade_date").alias("key"), F.lit("").alias("detail"))
    bars = checked.where(inside & (F.size("_failed") == 0)).select(*BAR.fieldNames())
    diagnostics = checked.groupBy(*SECURITY).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(inside & (F.size("_failed") == 0)).alias("normalized_rows"),
        F.count_if(~inside).alias("ignored_rows"),
        F.min(F.when(inside, F.col("trade_date"))).alias("first_date"),
        F.max(F.when(inside, F.col("trade_date"))).alias("last_date"))
    return bars, bad, diagnostics


def unique_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    return enforce_unique(bars, KEYS["bar"], "duplicate bar")


def replace_securities(bars: DataFrame, rebuilt: DataFrame, years: Sequence[int]) -> DataFrame:
    """The affected years with the rebuilt securities in place of the old rows.

    Only those years are read and returned, for a dynamic overwrite of their partitions.
    """
    year = F.year("trade_date")
    codes = rebuilt.select(*SECURITY).distinct()
    kept = missing_keys(bars.where(year.isin(*years)), codes, SECURITY)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in bars.schema.fields]
    return kept.unionByName(rebuilt.where(year.isin(*years)).select(*typed))


def transition_bar_checks(bars: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per code change: bars of both codes, and what contradicts the effective day.

    The change table goes to the bars as ``(exchange, code)`` rows, and bars come back as
    one row per code, combined before the shuffle.
    """
    codes = transitions.select(
        "exchange", F.explode(F.array("old_code", "new_code")).alias("code")).distinct()
    spans = bars.join(codes, list(SECURITY), "left_semi").groupBy(*SECURITY).agg(
        F.count(F.lit(1)).alias("bars"), F.min("trade_date").alias("first"),
        F.max("trade_date").alias("last"))

    def side(name: str) -> DataFrame:
        return spans.select("exchange", F.col("code").alias(f"{name}_code"),
                            F.col("bars").alias(f"{name}_bar_count"),
                            F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last"))

    result = (transitions.select("exchange", "old_code", "new_code", "effective_date")
              .join(side("old"), ["exchange", "old_code"], "left")
              .join(side("new"), ["exchange", "new_code"], "left")
              .fillna(0, ["old_bar_count", "new_bar_count"]))
    eff = F.col("effective_date")
    checks = {
        "predecessor has zero bars": F.col("old_bar_count") > 0,
        "successor has zero bars": F.col("new_bar_count") > 0,
        "predecessor bar survives transition": F.coalesce(F.col("old_last") < eff, F.lit(True)),
        "successor bar predates transition": F.coalesce(F.col("new_first") >= eff, F.lit(True)),
        "successor first bar is not the effective date": F.coalesce(F.col("new_first") == eff, F.lit(True)),
    }
    bad = result.select(
        F.explode(failed_checks(checks)).alias("check"),
        key_text("exchange", "old_code", "new_code").alias("key"), eff.cast("string").alias("detail"))
    return result, bad


def repair_transition(source_rows: DataFrame, bars: DataFrame, life: DataFrame,
                      transitions: DataFrame, rules: Rules,
                      years: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Rebuild the codes of a registered change from source rows, life as a filter.

    The successor's source may carry the predecessor's history under the new code; such
    rows fall outside the successor's life and are left out rather than rejected.
    """
    codes = transitions.select(
        "exchange", F.explode(F.array("old_code", "new_code")).alias("code")).distinct()
    targeted = source_rows.join(codes, list(SECURITY), "left_semi")
    rebuilt, faults, _ = normalize_bars(targeted, life, rules, outside="ignore")
    _, contradictions = transition_bar_checks(rebuilt, transitions)
    return replace_securities(bars, rebuilt, years), gather(faults, contradictions)
