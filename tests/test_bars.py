import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pitgate import schema
from pitgate.operators import bars as br
from pitgate.operators.trading_days import calendar_mismatch, security_days, venue_days, weekdays
from pitgate.schema import Rules
from pitgate.sources.readers import HeaderError, require_columns
from tests.helpers import checks, day, names, rows


def lives(spark, *items):
    return spark.createDataFrame([(e, c, day(a), day(b)) for e, c, a, b in items],
                                 "exchange string, code string, listed_from date, listed_to_exclusive date")


def payloads(spark, code, kline, shown=None):
    doc = json.dumps({"code": shown or code, "begin": 0, "end": 1, "kline": kline})
    return spark.createDataFrame([("SSE", code, doc)], "exchange string, code string, payload string")


KLINE = [[20141230, 21, 22.5, 20.8, 22, 150, 3200], [20150106, 22, 24, 21.5, 23.25, 420, 9600], [20150107, 23, 23.5, 22.75, 23, 310, 7150]]


def test_array_payload_is_cut_to_the_coverage(spark):
    raw, bad = br.explode_array_payload(payloads(spark, "600718", KLINE))
    assert checks(bad) == [] and raw.count() == 3
    made, faults, seen = br.normalize_bars(raw, lives(spark, ("SSE", "600718", "2010-01-01", None)), Rules(coverage_end=day("2015-01-07")))
    assert rows(made, "trade_date", "volume_shares", "amount_cny", "close") == [
        (day("2015-01-06"), 420, 9600, Decimal("23.250000")), (day("2015-01-07"), 310, 7150, Decimal("23.000000"))]
    assert checks(faults) == [] and rows(seen, "normalized_rows", "first_date") == [(2, day("2015-01-06"))]
    assert made.schema.simpleString() == schema.BAR.simpleString()


def test_bar_outside_life_is_a_violation(spark):
    raw, _ = br.explode_array_payload(payloads(spark, "600718", [[20150112, 31, 32, 30, 31, 4, 124]]))
    made, faults, _ = br.normalize_bars(raw, lives(spark, ("SSE", "600718", "2015-01-13", None)), Rules())
    assert rows(made) == [] and checks(faults) == [("outside lifecycle", "SSE:600718:2015-01-12")]


@pytest.mark.parametrize("kline, shown, want", [
    ([KLINE[1], KLINE[0]], None, "non-increasing dates"), ([KLINE[1], KLINE[1]], None, "non-increasing dates"),
    ([[20150105, 1, 1, 1, 1, 1]], None, "malformed kline"), (KLINE, "600719", "code mismatch"),
])
def test_malformed_payloads(spark, kline, shown, want):
    raw, bad = br.explode_array_payload(payloads(spark, "600718", kline, shown))
    assert names(bad) == [want] and raw.count() == 0


def test_row_faults(spark):
    raw, _ = br.explode_array_payload(payloads(spark, "600718", [
        [20150105, 10, 9, 9, 10, 1, 10], [20150106, "-", 11, 9, 10, 1, 10], [20150107, 10, 11, 9, 10, 1.5, 10], [20150108, 10, 11, 9, 10, 1, -1]]))
    _, faults, _ = br.normalize_bars(raw, lives(spark, ("SSE", "600718", "2010-01-01", None)), Rules())
    assert {c for c, k in checks(faults) if k.endswith("05")} == {"OHLC invariant"}
    assert "missing price" in {c for c, k in checks(faults) if k.endswith("06")}
    assert {c for c, k in checks(faults) if k.endswith("07")} == {"volume not a non-negative integer"}
    assert {c for c, k in checks(faults) if k.endswith("08")} == {"amount not a non-negative integer"}


def day_table(spark, data, requested):
    cols = ", ".join(f"`{c}` string" for c in br.DAY_TABLE_HEADER)
    return spark.createDataFrame(data, cols).withColumn("requested_day", F.lit(requested).cast("date"))


def test_day_table_units_and_scope(spark):
    table = day_table(spark, [
        ("2017-03-09", "000729", "a", "6", "6.1", "6.4", "6", "6.25", "0", "3.6", "22.41", ""),
        ("2017-03-09", "300418", "b", "8", "8", "8.2", "7.9", "8.1", "0", "5", "40", "")], "2017-03-09")
    raw, bad = br.day_table_rows(require_columns(table, br.DAY_TABLE_HEADER))
    made, faults, seen = br.normalize_bars(raw, lives(spark, ("SZSE", "000729", "1997-07-11", None)), Rules(),
                                           unit=br.TEN_THOUSAND, outside="ignore")
    assert rows(made, "code", "volume_shares", "amount_cny") == [("000729", 36000, 224100)]
    assert checks(bad) == checks(faults) == []
    total = seen.agg(F.sum("source_rows"), F.sum("ignored_rows")).first()
    assert tuple(total) == (2, 1)


def test_holiday_and_wrong_day(spark):
    blank = ("没有找到符合条件的数据！",) + ("",) * 11
    raw, bad = br.day_table_rows(day_table(spark, [blank], "2015-01-01"))
    assert raw.count() == 0 and checks(bad) == []
    raw, bad = br.day_table_rows(day_table(spark, [("2015-01-06", "000001") + ("1",) * 10], "2015-01-05"))
    assert raw.count() == 0 and names(bad) == ["source day mismatch"]


def test_header_contract(spark):
    with pytest.raises(HeaderError):
        require_columns(spark.createDataFrame([("x",)], "a string"), ["b"])


def bar_rows(spark, items):
    p = [Decimal("1")] * 4
    return spark.createDataFrame([("SSE", c, day(d), *p, 1, 1) for c, d in items], schema.BAR)


CHANGE = "exchange string, old_code string, new_code string, effective_date date"


def test_identity_checks(spark):
    change = spark.createDataFrame([("SSE", "601313", "601360", day("2018-02-28"))], CHANGE)
    _, ok = br.transition_bar_checks(bar_rows(spark, [("601313", "2018-02-14"), ("601360", "2018-02-28")]), change)
    assert checks(ok) == []
    _, bad = br.transition_bar_checks(bar_rows(spark, [("601313", "2018-02-28"), ("601360", "2018-02-27")]), change)
    assert names(bad) == ["predecessor bar survives transition", "successor bar predates transition",
                          "successor first bar is not the effective date"]
    _, none = br.transition_bar_checks(bar_rows(spark, [("1", "2018-02-28")]), change)
    assert names(none) == ["predecessor has zero bars", "successor has zero bars"]


def test_repair_replaces_only_the_codes_and_years(spark):
    change = spark.createDataFrame([("SSE", "601313", "601360", day("2018-02-28"))], CHANGE)
    life = lives(spark, ("SSE", "601313", "2012-01-16", "2018-02-28"), ("SSE", "601360", "2018-02-28", None))
    stored = bar_rows(spark, [("601360", "2018-02-14"), ("601360", "2018-02-28"), ("600718", "2018-02-14"), ("600718", "2019-01-02")])
    source = [(c, d) for c in ("601313", "601360") for d in ("2018-02-14", "2018-02-28")]
    text = spark.createDataFrame([("SSE", c, day(d), *["2"] * 6) for c, d in source],
                                 "exchange string, code string, trade_date date, open string, high string, low string, "
                                 "close string, volume string, amount string")
    fixed, bad = br.repair_transition(text, stored, life, change, Rules(), [2018])
    assert checks(bad) == []
    assert rows(fixed, "code", "trade_date") == [
        ("600718", day("2018-02-14")), ("601313", day("2018-02-14")), ("601360", day("2018-02-28"))]


def test_calendars(spark):
    assert [r[0] for r in weekdays(spark, day("2026-07-24"), day("2026-07-28")).orderBy("day").collect()] == [
        day("2026-07-24"), day("2026-07-27"), day("2026-07-28")]
    b = bar_rows(spark, [("1", "2015-01-05"), ("1", "2015-01-06")]).unionByName(
        bar_rows(spark, [("2", "2015-01-06")]).withColumn("exchange", F.lit("SZSE")))
    assert rows(calendar_mismatch(venue_days(b), "SSE", "SZSE")) == [(day("2015-01-05"), "SSE")]
    spread = security_days(lives(spark, ("SSE", "1", "2015-01-01", "2015-01-06")), venue_days(b), day("2015-01-01"), day("2015-12-31"))
    assert rows(spread, "trade_date") == [(day("2015-01-05"),)]


def test_texts_are_parsed_once_a_row(spark):
    parsed, bad = br.explode_array_payload(payloads(spark, "600718", KLINE))
    made, faults, _ = br.normalize_bars(parsed, lives(spark, ("SSE", "600718", "2010-01-01", None)), Rules())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(parsed).count("from_json(") == plan(bad).count("from_json(") == 1
    # Every check and filter that uses a price, volume or money tried its text anew.
    assert plan(made).count("decimal(30,12)") < 50 and plan(faults).count("decimal(30,12)") < 50
