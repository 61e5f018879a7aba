"""One key holds most rows: it has to spread over the tasks, and nothing may be lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitgate.operators import checks as ck
from pitgate.operators.aggregates import dedupe, has_conflict, unique_value
from pitgate.operators.blocks import running_total
from pitgate.operators.joins import interval_join
from pitgate.schema import Rules

RULES = Rules(coverage_start=dt.date(2000, 1, 1), coverage_end=dt.date(2015, 12, 31))


@pytest.fixture
def plain_shuffles(spark):
    """No coalescing and no broadcasts, as with partitions too large for either."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot(spark, n=40_000):
    """Half the rows on one security, the rest over a thousand."""
    day = F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") * 7 % 5800).cast("int"))
    code = F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 1000).cast("string"))
    return spark.range(n).select(F.lit("SSE").alias("exchange"), code.alias("code"), day.alias("trade_date"), "id")


def largest_share(df):
    per_task = df.where("code = 'hot'").groupBy(F.spark_partition_id().alias("t")).count()
    total, most = per_task.agg(F.sum("count"), F.max("count")).first()
    return most / total


def test_block_window_spreads_the_hot_key(spark, plain_shuffles):
    got = running_total(hot(spark), ["exchange", "code"], "trade_date", F.lit(1), "n", order=["id"])
    assert largest_share(got) < 0.35
    last = got.where("code = 'hot'").agg(F.max("n"), F.count_distinct("n")).first()
    assert tuple(last) == (20_000, 20_000)


def test_interval_join_spreads_the_hot_key(spark, plain_shuffles):
    rows = hot(spark)
    life = rows.select("exchange", "code").distinct().withColumns({
        "listed_from": F.lit(dt.date(1999, 1, 1)), "listed_to_exclusive": F.lit(None).cast("date")})
    got = interval_join(rows, life, "trade_date", RULES)
    assert got.count() == 40_000 and largest_share(got) < 0.35


@pytest.mark.parametrize("make", [
    lambda df: ck.enforce_unique(df, ["code"])[1],
    lambda df: ck.duplicate_keys(df, ["code"]),
    lambda df: df.groupBy("code").agg(unique_value(F.col("v")).alias("u"), has_conflict(F.col("v")).alias("c")),
    lambda df: dedupe(df, ["code", "v"]),
])
def test_copies_combine_before_the_shuffle(spark, plain_shuffles, make):
    df = hot(spark).select("code", F.lit(1).alias("v"), F.lit("payload").alias("p"))
    text = make(df)._jdf.queryExecution().executedPlan().toString()
    below = text.split("Exchange hashpartitioning", 1)[1]
    assert "partial_" in below


def test_uniqueness_reports_every_copy_once(spark):
    clean, bad = ck.enforce_unique(hot(spark), ["code"])
    assert clean.count() == 0
    assert bad.agg(F.sum(F.col("detail").cast("bigint"))).first()[0] == 40_000
