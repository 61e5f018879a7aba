import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog import bindings, load
from catalog import gates as gate_queries
from pitgate.operators.blocks import strict_asof
from pitgate.operators.control import factor_events

SF = "/root/testdata/sf0.001"


@pytest.fixture
def seven(spark):
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield spark
    spark.conf.set(name, was)


@pytest.mark.parametrize("name", ["adjustment_faults", "bootstrapped_chain", "transition_repair", "gate_factors"])
def test_sources_are_read_once_and_stored(spark, name):
    files = load().QUERIES[name](spark, SF).inputFiles()
    assert files and not [f for f in files if "testdata" in f]


def test_final_figures_make_the_ledger_once(spark, monkeypatch):
    made, whole = [], bindings.action_ledger
    monkeypatch.setattr(bindings, "action_ledger", lambda spark, sf: made.append(sf) or whole(spark, sf))
    gate_queries._final_facts(spark, SF)
    assert len(made) == 1


def test_asof_rows_are_not_merged_into_few_tasks(seven):
    bars = bindings.closes(seven, SF)
    out = strict_asof(bindings.action_ledger(seven, SF), bars, ["exchange", "code"], "ex_date", "trade_date", ["close"], block=None)
    assert out.rdd.getNumPartitions() == 7


def test_factor_rows_are_not_merged_into_few_tasks(seven):
    none = seven.createDataFrame([], "exchange string, code string, operate_date date, seq long, cash_ps_before_tax double, "
                                     "stock_ps double, reserve_to_stock_ps double, event_detail string")
    assert factor_events(bindings.factors(seven, SF), none)[0].rdd.getNumPartitions() == 7


def test_traded_days_are_merged_and_never_broadcast(spark, tmp_path):
    """Days grow out of few lives, trades lie in small files: neither may go whole through the driver."""
    n = F.col("id")
    made = spark.range(6000).select(
        n.alias("l_orderkey"), (n % 4).cast("int").alias("l_linenumber"), (n % 97).alias("l_partkey"),
        (n % 30).alias("l_suppkey"), (n * 7 % 50 + 1).cast("double").alias("l_quantity"), F.lit(12.5).alias("l_extendedprice"),
        F.date_add(F.lit(dt.date(1995, 1, 2)), (n * 11 % 2500).cast("int")).cast("timestamp").alias("l_shipdate"))
    made.write.parquet(f"{tmp_path}/lineitem.parquet")
    trades = [(r["l_suppkey"], r["l_shipdate"].date(), r["l_quantity"]) for r in made.collect()]
    listed = {}
    for k, d, _ in trades:
        listed[k] = min(d, listed.get(k, d))
    listed = {k: d + dt.timedelta(k % 7 * 40) for k, d in listed.items()}
    filed = {(k, d + dt.timedelta(0 if q > 10 else 1)) for k, d, q in trades}
    end = {k: dt.date(2000, 1, 1) if k % 5 == 0 else dt.date(2001, 7, 1) for k in listed}
    want = {("SSE" if k % 2 else "SZSE", f"{k:06}", str(d)) for k, d, _ in trades
            if max(listed[k], dt.date(1995, 2, 1)) <= d < end[k] and d.weekday() < 5 and (k, d) not in filed}

    got = load().QUERIES["tradable_without_bar"](spark, str(tmp_path))
    assert want and sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [exchange#" in plan and "BroadcastHashJoin [exchange#" not in plan
