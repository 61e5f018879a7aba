"""Plan shapes that have to hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import bindings as b
from catalog import load
from pitgate.operators import checks as ck
from pitgate.operators.blocks import running_total
from pitgate.operators.joins import interval_join, near_pairs
from pitgate.schema import SECURITY

CORE = ("bars_in_life", "identity_remap", "prior_close_asof", "near_day_pairs", "set_reconcile", "delisting_periods",
        "ledger_merge", "control_reconciliation", "adjustment_chain", "factor_control", "factor_control_counts",
        "state_partition", "gate_factors", "gate_report", "partition_digests")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", CORE)
def test_no_nested_loops_when_nothing_fits_a_broadcast(spark, sf, no_broadcast, name):
    text = plan(load().QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "EvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(b.px(spark, sf).where("trade_date >= date '2001-01-01' and q > 10").select("code", "q"))
    assert "PushedFilters: [IsNotNull(l_quantity)" in text or "IsNotNull(l_shipdate)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_comment" not in schema and "l_extendedprice" not in schema and "l_tax" not in schema


def test_time_joins_split_a_security_by_year(spark, sf, no_broadcast):
    joined = interval_join(b.bars(spark, sf), b.intervals(spark, sf), "trade_date", b.RULES)
    assert re.search(r"SortMergeJoin \[exchange#\d+, code#\d+, _slice#\d+\]", plan(joined))
    pairs = near_pairs(b.action_ledger(spark, sf), b.bars(spark, sf).select(*SECURITY, "trade_date"), "ex_date", "trade_date", 10)
    assert re.search(r"SortMergeJoin \[exchange#\d+, code#\d+, _slice#\d+\]", plan(pairs))


def test_block_window_partitions_by_key_and_block(spark, sf):
    text = plan(running_total(b.bars(spark, sf), SECURITY, "trade_date", F.lit(1), "n"))
    assert re.search(r"Exchange hashpartitioning\(exchange#\d+, code#\d+, _block#\d+", text)


def test_samples_are_limited_before_the_shuffle(spark):
    many = spark.range(10).select((F.col("id") % 2).cast("string").alias("check"), F.col("id").cast("string").alias("key"), F.lit("").alias("detail"))
    text = plan(ck.samples(many.repartition(3), 2))
    assert "WindowGroupLimit" in text and "Partial" in text
