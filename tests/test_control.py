import datetime as dt
import random

import pytest

from pitgate.operators import control as ct
from pitgate.schema import Rules
from tests.helpers import checks, day, names, rows

FACTORS = "exchange string, code string, effective_date date, fore_adjust_factor double, back_adjust_factor double"
CHAIN = "exchange string, code string, ex_date date, action_type string, back_adjust_multiplier double"


def run(spark, factors, actions, changes=()):
    frame = lambda items, ddl: spark.createDataFrame(items, ddl)
    to_day = lambda d: day(d) if isinstance(d, str) else d
    return ct.factor_control(
        frame([("SSE", c, to_day(d), f, b) for c, d, f, b in actions], CHAIN),
        frame([("SSE", c, to_day(d), float(f), float(b)) for c, d, f, b in factors], FACTORS),
        frame([("SSE", o, n, day(d)) for o, n, d in changes], "exchange string, old_code string, new_code string, effective_date date"),
        Rules())


FIRST = ("603009", "2018-11-01", 1, 1)


@pytest.mark.parametrize("second, action, want", [
    ((0.4, 1.25), ("CASH_DIVIDEND", 1.25), {"matched": 1, "mismatches": 0, "rebases": 1}),
    ((1, 1), ("CASH_DIVIDEND", 1.002), {"matched": 0, "unobserved": 1, "mismatches": 0}),
    ((1, 1), ("CASH_DIVIDEND", 1.0004), {"tiny_unobserved": 1, "unobserved": 0}),
    ((1.3, 1.3), ("CAPITAL_TRANSFER", 1.15), {"matched": 0, "mismatches": 1}),
])
def test_cases(spark, second, action, want):
    actions, changes, bad = run(spark, [FIRST, ("603009", "2019-03-05", *second)], [("603009", "2019-03-04", *action)])
    counts = ct.control_counts(actions, changes).first().asDict()
    assert {k: counts[k] for k in want} == want
    assert bool(checks(bad)) == (want.get("mismatches", 0) > 0)


def test_uncovered_actions(spark):
    actions, _, _ = run(spark, [FIRST, ("603009", "2019-03-05", 1.1, 1.1)], [
        ("603009", "2018-11-01", "CASH_DIVIDEND", 1.1), ("603009", "2019-03-06", "CASH_DIVIDEND", 1.1), ("603010", "2020-02-03", "CASH_DIVIDEND", 1.1)])
    assert rows(actions, "status") == [("NOT_COVERED",)] * 3


def test_nonpositive_factors_neither_count_nor_reset(spark):
    _, changes, _ = run(spark, [FIRST, ("603009", "2020-02-01", 0, 2), ("603009", "2020-03-01", 1.5, 1.5)], [("603009", "2021-01-01", "X", 1.0)])
    assert rows(changes, "change_date", "back_ratio", "is_change") == [(day("2020-03-01"), 1.5, True)]


def test_factor_rows_follow_the_code_of_their_day(spark):
    actions, _, _ = run(spark, [("603881", "2018-01-01", 1, 1), ("603881", "2018-02-01", 1.1, 1.1), ("603881", "2018-03-01", 1.1, 1.1)],
                        [("603118", "2018-02-01", "CASH_DIVIDEND", 1.1)], [("603118", "603881", "2018-02-28")])
    assert rows(actions, "status", "change_date") == [("MATCHED", day("2018-02-01"))]


def sequential_matches(actions, changes, days):
    used, out = set(), {}
    for d, theory in sorted(actions):
        options = sorted((abs((c - d).days), abs(v - theory), c) for c, v in changes if c not in used and abs((c - d).days) <= days)
        out[d] = options[0][2] if options else None
        used |= {options[0][2]} if options else set()
    return out


def test_random_matches_equal_the_greedy_walk(spark):
    rng = random.Random(23)
    base = dt.date(2018, 1, 1)
    acts, chgs, want = [], [], {}
    for k in range(25):
        code, span = f"{k:03d}", rng.choice([60, 400])
        mine = [(base + dt.timedelta(n), rng.choice([1.1, 1.2, 1.3])) for n in rng.sample(range(span), 14)]
        seen = [(base + dt.timedelta(n), rng.choice([1.1, 1.2, 1.3])) for n in rng.sample(range(span), 14)]
        acts += [("SSE", code, d, v) for d, v in mine]
        chgs += [("SSE", code, d, v) for d, v in seen]
        want.update({(code, d): c for d, c in sequential_matches(mine, seen, 10).items()})
    got = ct.greedy_match(spark.createDataFrame(acts, "exchange string, code string, ex_date date, theory double"),
                          spark.createDataFrame(chgs, "exchange string, code string, change_date date, observed double"), 10)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for rows_a_batch in (spark.conf.get(size), "3"):  # the sweep goes on from batch to batch
        before = spark.conf.get(size)
        spark.conf.set(size, rows_a_batch)
        found = {(r["code"], r["ex_date"]): r["change_date"] for r in got.collect()}
        spark.conf.set(size, before)
        assert found == want


def test_factor_events(spark):
    from tests.helpers import dec

    factors = spark.createDataFrame([("SSE", c, day("2019-03-04"), dec(f), dec(1), dec(1)) for c, f in [("1", 1), ("2", 1), ("3", 0)]],
                                    "exchange string, code string, effective_date date, fore_adjust_factor decimal(18,6), "
                                    "back_adjust_factor decimal(18,6), adjust_factor decimal(18,6)")
    dividends = spark.createDataFrame([
        ("SSE", "1", day("2019-03-04"), 2, dec(9), None, None, "later"), ("SSE", "1", day("2019-03-04"), 1, dec(1), dec(1), None, "first"),
        ("SSE", "3", day("2019-03-04"), 1, None, None, dec(1), "x")],
        "exchange string, code string, operate_date date, seq int, cash_ps_before_tax decimal(18,6), stock_ps decimal(18,6), "
        "reserve_to_stock_ps decimal(18,6), event_detail string")
    events, bad = ct.factor_events(factors, dividends)
    assert rows(events, "code", "event_type", "event_detail") == [
        ("1", "CASH_AND_STOCK_DISTRIBUTION", "first"), ("2", "UNMATCHED_FACTOR_EVENT", None), ("3", "STOCK_DIVIDEND_OR_CAPITAL_TRANSFER", "x")]
    assert names(bad) == ["nonpositive factor", "unmatched factor event"]


def test_doubled_rows_take_no_part(spark):
    actions, _, bad = run(spark, [FIRST, ("603009", "2019-03-05", 1.1, 1.1), ("603009", "2019-03-05", 1.2, 1.2), ("603009", "2019-06-03", 1, 1)],
                          [("603009", "2019-03-04", "CASH_DIVIDEND", 1.1), ("603010", "2019-03-04", "X", 1.0), ("603010", "2019-03-04", "X", 1.0)])
    assert rows(actions, "status") == [("UNOBSERVED",)]
    assert checks(bad) == [("action listed twice", "SSE:603010:2019-03-04"), ("two factor rows of one day", "SSE:603009:2019-03-05")]


def test_one_frame_holds_actions_changes_and_faults(spark):
    chain = spark.createDataFrame(
        [("SSE", "1", day("2018-02-01"), "X", 1.1), ("SSE", "1", day("2018-02-05"), "X", 1.3), (None, None, None, "X", None)], CHAIN)
    factors = spark.createDataFrame(
        [("SSE", "1", day(d), f, f) for d, f in [("2018-01-01", 1.0), ("2018-02-03", 1.1), ("2018-08-01", 1.2), ("2018-09-01", 1.2)]], FACTORS)
    none = spark.createDataFrame([], "exchange string, old_code string, new_code string, effective_date date")
    tagged = ct.tagged_control(chain, factors, none, Rules())
    assert rows(ct.control_actions(tagged, Rules()), "ex_date", "status", "change_date", "distance") == [
        (None, "NOT_COVERED", None, None), (day("2018-02-01"), "MATCHED", day("2018-02-03"), 2), (day("2018-02-05"), "UNOBSERVED", None, None)]
    assert rows(ct.control_changes(tagged, Rules()), "change_date", "is_change", "supplier_only") == [
        (day("2018-02-03"), True, False), (day("2018-08-01"), True, True), (day("2018-09-01"), False, False)]
    assert rows(ct.control_faults(tagged, Rules())) == []


def test_actions_and_factors_are_shuffled_twice(spark, sf):
    from tests.helpers import shuffles_above

    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        tagged = ct.tagged_control(spark.read.schema(CHAIN).parquet(f"{sf}/orders.parquet"),
                                   spark.read.schema(FACTORS).parquet(f"{sf}/lineitem.parquet"),
                                   spark.createDataFrame([], "exchange string, old_code string, new_code string, effective_date date"), Rules())
        assert shuffles_above(tagged, r"Scan parquet \[.*ex_date") == [2]
        assert max(shuffles_above(tagged, r"Scan parquet \[.*effective_date")) <= 3  # one more where code changes are too many to broadcast
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
