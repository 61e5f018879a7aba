"""Counts, spans, digests, samples, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.bindings import with_ctes
from catalog.registry import plain, query
from pitgate.operators import aggregates as ag
from pitgate.operators import checks as ck
from pitgate.operators.blocks import last_before
from pitgate.plans.facts import below_floor, canonical_fingerprint, facts_of
from pitgate.schema import KEYS, SECURITY
from pitgate.sources.writers import rank_shards

BAR_KEY = list(KEYS["bar"])


@query("counts_by_category", "A1", """
select event_type, count(*) as n, count_if(value > 50) as large, count_if(user_id % 2 = 0) as even_users from events group by 1""")
def counts_by_category(spark, sf):
    return b.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"),
        F.count_if(F.col("user_id") % 2 == 0).alias("even_users"))


@query("distinct_dates_codes", "A3", with_ctes("""
select exchange, count(distinct trade_date) as days, count(distinct code) as codes, count(*) as bars from bars group by 1"""))
def distinct_dates_codes(spark, sf):
    return b.bars(spark, sf).groupBy("exchange").agg(
        F.count_distinct("trade_date").alias("days"), F.count_distinct("code").alias("codes"),
        F.count(F.lit(1)).alias("bars"))


@query("bar_spans", "A4", with_ctes("""
select exchange, code, count(*) as bars, cast(min(trade_date) as varchar) as first_day, cast(max(trade_date) as varchar) as last_day
from bars group by 1, 2"""))
def bar_spans(spark, sf):
    return plain(b.bars(spark, sf).groupBy(*SECURITY).agg(
        F.count(F.lit(1)).alias("bars"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")))


@query("duplicate_keys", "A5", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date, count(*) as n from px group by 1, 2, 3 having count(*) > 1"""))
def duplicate_keys(spark, sf):
    return plain(ck.duplicate_keys(b.px(spark, sf), BAR_KEY))


@query("unique_rows", "A5", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date, cast(min(p) as double) as p, min(l_orderkey) as l_orderkey
from px group by 1, 2, 3 having count(*) = 1"""))
def unique_rows(spark, sf):
    clean, _ = ck.enforce_unique(b.px(spark, sf), BAR_KEY)
    return plain(clean.select(*BAR_KEY, "p", "l_orderkey"))


_LANE = "sum(cast('0x' || substr(d, {0}, 15) as bigint))::decimal(38,0)::varchar"
DIGEST_SQL = ("sha256(concat_ws(':', count(*)::varchar, " + ", ".join(_LANE.format(1 + 15 * i) for i in range(4)) + "))")
_LINES = ("lines", """select exchange, year(trade_date) as year, sha256(concat_ws(',', exchange, code, cast(trade_date as varchar),
    cast(open as varchar), cast(high as varchar), cast(low as varchar), cast(close as varchar), cast(volume_shares as varchar), cast(amount_cny as varchar))) as d from bars""")
_PARTS = ("parts", f"select exchange, year, count(*) as n, {DIGEST_SQL} as digest from lines group by 1, 2")


def partition_digests(bars, year=None):
    """Rows and content digest per (exchange, year); ``year`` names a stored column."""
    content = F.concat_ws(",", *[F.col(c).cast("string") for c in (
        *BAR_KEY, "open", "high", "low", "close", "volume_shares", "amount_cny")])
    part = F.year("trade_date") if year is None else F.col(year)
    return bars.groupBy("exchange", part.alias("year")).agg(
        F.count(F.lit(1)).alias("n"), ag.content_digest(content).alias("digest"))


@query("partition_digests", "A12 N17", with_ctes("select exchange, year, n, digest from parts", _LINES, _PARTS))
def partition_digests_query(spark, sf):
    return partition_digests(b.bars(spark, sf))


@query("dataset_fingerprint", "A12", with_ctes("""
select sha256(string_agg(line, chr(10) order by line)) as fingerprint
from (select exchange || '_' || year || ':' || digest || ':' || n as line from parts)""", _LINES, _PARTS))
def dataset_fingerprint(spark, sf):
    line = F.concat(F.concat_ws("_", "exchange", F.col("year").cast("string")), F.lit(":"), "digest",
                    F.lit(":"), F.col("n").cast("string"))
    return partition_digests(b.bars(spark, sf)).agg(ag.manifest_fingerprint(line).alias("fingerprint"))


@query("canonical_facts", "N18 GF", with_ctes("""
select sha256('{"' || 'codes":"' || (select count(distinct code) from bars) || '","rows":"' || (select count(*) from bars) || '"}') as fingerprint"""))
def canonical_facts(spark, sf):
    totals = b.bars(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("code").alias("codes"))
    return canonical_fingerprint(facts_of(totals))


@query("sorted_sample", "A13 O1 O2", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50""")
def sorted_sample(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("check_samples", "A13 O2 W10", """
select "check", rank, key from (select 'status ' || o_orderstatus as "check", cast(o_orderkey as varchar) as key,
  row_number() over (partition by o_orderstatus order by cast(o_orderkey as varchar)) as rank from orders) where rank <= 20""")
def check_samples(spark, sf):
    found = ck.violations(b.table(spark, sf, "orders"), "", ck.key_text("o_orderkey"), F.col("o_orderstatus"))
    named = found.withColumn("check", F.concat(F.lit("status "), "detail"))
    return ck.samples(named, 20).select("check", "rank", "key")


@query("smallest_keys", "A13", """
select distinct l_suppkey, l_partkey from lineitem order by 1, 2 limit 100""")
def smallest_keys(spark, sf):
    rows = b.table(spark, sf, "lineitem")
    return ck.sorted_sample(rows.select("l_suppkey", "l_partkey").distinct(), ["l_suppkey", "l_partkey"], 100)


@query("last_page_wins", "A17", """
select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1""")
def last_page_wins(spark, sf):
    rows = b.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return ag.last_page_wins(rows, ["user_id"], "event_id").select("user_id", "event_type", "value")


@query("plausibility_floors", "A18", with_ctes("""
select 'implausibly small figure' as "check", name as key, cast(value as varchar) as detail from (
  select 'bars' as name, count(*) as value, 1000000000 as floor from bars union all
  select 'codes', count(distinct code), 10 from bars union all select 'days', count(distinct trade_date), 2800 from bars) where value < floor"""))
def plausibility_floors(spark, sf):
    totals = b.bars(spark, sf).agg(
        F.count(F.lit(1)).alias("bars"), F.count_distinct("code").alias("codes"),
        F.count_distinct("trade_date").alias("days"))
    floors = spark.createDataFrame([("bars", 1_000_000_000), ("codes", 10), ("days", 2800)], "name string, floor bigint")
    return below_floor(facts_of(totals), floors)


@query("rank_shards", "S12 W10", with_ctes("""
select exchange, code, position, position % 8 as shard from (
  select exchange, code, row_number() over (order by exchange, code) - 1 as position from life)"""))
def rank_shards_query(spark, sf):
    prefix = F.concat("exchange", F.substring("code", 1, 4))
    return rank_shards(b.px(spark, sf), SECURITY, prefix, 8)


@query("shard_completeness", "A19", with_ctes("""
select count(distinct position % 8) as shards_found, 8 as declared, 1 as declared_once, cast(count(distinct position % 8) = 8 as integer) as complete
from (select row_number() over (order by exchange, code) - 1 as position from life)"""))
def shard_completeness(spark, sf):
    prefix = F.concat("exchange", F.substring("code", 1, 4))
    shards = rank_shards(b.px(spark, sf), SECURITY, prefix, 8).withColumn("shards", F.lit(8))
    return plain(ag.completeness(shards, "shard", "shards"))


@query("rising_key_check", "W6", """
select event_type, event_id, previous, value from (select *, lag(value) over (partition by event_type order by event_id) as previous from events)
where value <= previous""")
def rising_key_check(spark, sf):
    rows = b.table(spark, sf, "events").select("event_type", "event_id", "value")
    linked = last_before(rows, ["event_type"], "event_id", F.col("value"), "previous",
                         block=lambda position: F.floor(position / 4096))
    return linked.where("value <= previous").select("event_type", "event_id", "previous", "value")


@query("row_accounting", "A14", with_ctes("""
select exchange, year(trade_date) as year, count(*) as scanned, cast(sum(n) as bigint) as source_rows, cast(count(*) = sum(n) as integer) as accounted
from (select exchange, trade_date, code, count(*) as n from px group by 1, 2, 3) group by 1, 2"""))
def row_accounting(spark, sf):
    scanned = b.bars(spark, sf).groupBy("exchange", F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias("scanned"))
    sources = b.px(spark, sf).groupBy("exchange", F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias("source_rows"))
    joined = scanned.join(sources, ["exchange", "year"], "full_outer")
    return plain(joined.withColumn("accounted", F.col("scanned") == F.col("source_rows")))
