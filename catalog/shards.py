"""Audits of shards: files, manifests and rows that differ in known places."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.bindings import RULES
from catalog.gates import summary_sql
from catalog.registry import query
from catalog.states import _ruled
from pitgate.operators import actions as ac
from pitgate.operators.checks import summarize
from pitgate.plans import shards as sh
from pitgate.schema import SECURITY
from pitgate.sources import files as fl
from pitgate.sources.writers import shared_folder, stored

LANES = [sh.Lane("PRIMARY", 8), sh.Lane("RIGHTS", 4, venue="SZSE", optional=True), sh.Lane("CONTROL", 1, queried=False)]


def _k():
    """A security's code as a number; a function, for a column needs a running session."""
    return F.col("code").cast("bigint")


def _written(spark, rows, name):
    """Rows with lane and shard as one file a shard: the rows read again, and the files' digests."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.repartition(*sh.SHARD).write.partitionBy(*sh.SHARD).parquet(path)
    named = F.concat(F.lit("lane="), fl.partition_value("path", "lane"), F.lit("/shard="), fl.partition_value("path", "shard"))
    files = stored(fl.digests(spark, path).select(named.alias("file"), "sha256"), f"{name}-digests")
    return spark.read.parquet(path), files


def _manifests(counts, files, universe):
    """What the shards would declare if nothing were wrong; ``universe`` has lane, shard and its securities."""
    asked = universe.groupBy(*sh.SHARD).agg(F.count(F.lit(1)).alias("securities"))
    data_file = F.concat(F.lit("lane="), "lane", F.lit("/shard="), F.col("shard").cast("string"))
    held = counts.drop("securities").withColumn("data_file", data_file).join(
        files.select(F.col("file").alias("data_file"), F.col("sha256").alias("data_sha256")), "data_file")
    return held.join(asked, sh.SHARD, "left").withColumns({
        "securities": F.coalesce("securities", F.lit(0)), "errors": F.array().cast("array<string>")})


def _spoilt(manifests, lane, lost, altered, error):
    """The manifests without one shard, one with another digest, and one with an error of its source."""
    at = lambda shard: (F.col("lane") == lane) & (F.col("shard") == shard)
    return manifests.where(~at(lost)).withColumns({
        "data_sha256": F.when(at(altered), "x").otherwise(F.col("data_sha256")),
        "errors": F.when(at(error), F.array(F.lit("page 2 timed out"))).otherwise(F.col("errors"))})


_PRIMARY = ("rows_", """select 'PRIMARY' as lane, cast(code as bigint) % 8 as shard, exchange, code, ex_date from components
  union all select 'RIGHTS', cast(code as bigint) % 4, exchange, code, ex_date from control_components where action_component = 'RIGHTS' and exchange = 'SZSE'
  union all select 'CONTROL', 0, exchange, code, ex_date from control_components""")
_MADE = ("man", "select distinct lane, shard from rows_ where not (lane = 'PRIMARY' and shard = 5)")


@query("gate_ledger_shards", "S12 S14 A14 A19 C13 G5a", summary_sql("""
select 'shards missing' as "check", lane as key from (values ('PRIMARY', 8), ('RIGHTS', 4), ('CONTROL', 1)) v(lane, n)
  left join (select lane, count(*) as found, max(shard) as top from man group by 1) using (lane)
  where not (lane = 'RIGHTS' and found is null) and (coalesce(found, 0) <> n or top <> n - 1)
union all select 'file of no shard', 'lane=PRIMARY/shard=5' from (select 1 from rows_ where lane = 'PRIMARY' and shard = 5 limit 1)
union all select 'shard file digest differs', 'PRIMARY:2:lane=PRIMARY/shard=2' from man where lane = 'PRIMARY' and shard = 2
union all select 'source error', 'PRIMARY:3' from man where lane = 'PRIMARY' and shard = 3
union all select 'declared and found counts differ', lane || ':' || shard from (select distinct lane, shard from rows_) where lane = 'PRIMARY' and shard in (4, 5)
union all select 'queried securities and universe differ', 'PRIMARY' from (select count(*) as off from life where k % 8 not in (select shard from man where lane = 'PRIMARY')) where off > 0
union all select 'queried securities and universe differ', 'RIGHTS' from (select count(*) as off from life where exchange = 'SZSE' and k % 4 not in (select shard from man where lane = 'RIGHTS')) where off > 0
union all select 'native event missing from the ledger', exchange || ':' || code || ':' || cast(ex_date as varchar) from (
  select exchange, code, ex_date from control_components where action_component <> 'RIGHTS'
  except select exchange, code, ex_date + case when k % 12 = 5 then 1 else 0 end from action_ledger)
union all select 'action without amounts', exchange || ':' || code || ':' || cast(ex_date + case when k % 12 = 5 then 1 else 0 end as varchar) from action_ledger where action_type = ''
union all select case when l.code is null then 'action of an unknown security' else 'action outside the life of its security' end, c.exchange || ':' || c.code || ':' || cast(c.ex_date as varchar)
  from components c left join life l using (exchange, code)
  where l.code is null or c.ex_date < l.listed_from or c.ex_date >= l.listed_to_exclusive or c.ex_date not between date '1995-02-01' and date '2001-06-30'
""", _PRIMARY, _MADE))
def gate_ledger_shards(spark, sf):
    """The ledger's shards with a manifest lost, a digest altered, an error, a wrong count, and actions moved by a day."""
    primary, control = b.components(spark, sf), b.control_components(spark, sf)
    placed = lambda rows, lane, n: rows.select(
        F.lit(lane).alias("lane"), F.pmod(_k(), F.lit(n)).cast("int").alias("shard"), *ac.ACTION_KEY, "action_component", "source_id")
    second = control.where("action_component = 'RIGHTS' and exchange = 'SZSE'")
    rows, files = _written(spark, placed(primary, "PRIMARY", 8).unionByName(placed(second, "RIGHTS", 4)).unionByName(
        placed(control, "CONTROL", 1)), "ledger-shards")
    life = stored(b.life(spark, sf), "life")
    asked = life.select(F.lit("PRIMARY").alias("lane"), F.pmod(_k(), F.lit(8)).cast("int").alias("shard")).unionByName(
        life.where("exchange = 'SZSE'").select(F.lit("RIGHTS").alias("lane"), F.pmod(_k(), F.lit(4)).cast("int").alias("shard")))
    counts = rows.groupBy(*sh.SHARD).agg(F.count(F.lit(1)).alias("rows"))
    more = ((F.col("lane") == "PRIMARY") & (F.col("shard") == 4)).cast("int")
    manifests = stored(_spoilt(_manifests(counts, files, asked), "PRIMARY", lost=5, altered=2, error=3).withColumn(
        "rows", F.col("rows") + more), "ledger-manifests")
    ledger = b.action_ledger(spark, sf).withColumn("ex_date", F.date_add("ex_date", F.when(F.col("k") % 12 == 5, 1).otherwise(0)))
    outside = ac.lifecycle_violations(primary, life, RULES)
    return summarize(sh.ledger_gate(manifests, files, rows, rows.where("lane = 'CONTROL'"), life, ledger, outside, LANES))


@query("gate_state_shards", "G4 S12 S14 A14 A19", summary_sql("""
select 'shards missing' as "check", 'STATE' as key from (select count(distinct k % 16) as n from life where k % 16 <> 7) where n <> 16
union all select 'file of no shard', 'lane=STATE/shard=7' from (select 1 from life where k % 16 = 7 limit 1)
union all select 'shard file digest differs', 'STATE:2:lane=STATE/shard=2' from (select 1 from life where k % 16 = 2 limit 1)
union all select 'source error', 'STATE:4' from (select 1 from life where k % 16 = 4 limit 1)
union all select 'declared and found counts differ', 'STATE:3' from (select 1 from life where k % 16 = 3 limit 1)
union all select 'declared and found counts differ', 'STATE:7' from (
  select unnest([count(distinct code), count(*), count_if(tradable), count_if(not tradable), count_if(risk_warning)]) as n from state where k % 16 = 7) where n > 0
union all select 'queried securities and universe differ', 'STATE' from (select 1 from life where k % 16 = 7 limit 1)
union all select 'security of no source', exchange || ':' || code from life where k % 37 = 11
union all select 'rows of no source', exchange || ':' || code from (select distinct exchange, code from state where k % 37 = 11)
union all select 'source hash missing', exchange || ':' || code from (select distinct exchange, code, k from state) where k % 37 <> 11 and k % 18 = 4
union all select 'source rows differ from state rows', exchange || ':' || code from (select distinct exchange, code, k from state) where k % 37 <> 11 and k % 14 = 2
union all select 'relisting day that is not on the list', exchange || ':' || code || ':2000-02-01' from life where k % 6 <> 4 and k % 29 = 3
union all select 'relisting day that no manifest has', exchange || ':' || code || ':2000-02-01' from life where k % 6 = 4 and k % 29 <> 3 and k % 4 = 0"""))
def gate_state_shards(spark, sf):
    """The state's sixteen shards with faults in manifests, sources and relisting days."""
    life = stored(b.life(spark, sf), "life")
    shard = F.pmod(F.col("k"), F.lit(16)).cast("int").alias("shard")
    ruled = _ruled(spark, sf, life).withColumns({"lane": F.lit("STATE"), "shard": F.pmod(_k(), F.lit(16)).cast("int")})
    state, files = _written(spark, ruled.select(*sh.SHARD, *SECURITY, "trade_date", "tradable", "risk_warning", "limit_rule"), "state-shards")
    by_shard, each = sh.state_counts_by_shard(state)
    each = stored(each, "state-counts")
    asked = life.select(F.lit("STATE").alias("lane"), shard)
    manifests = stored(_spoilt(_manifests(by_shard, files, asked), "STATE", lost=7, altered=2, error=4).withColumn(
        "suspended", F.col("suspended") + (F.col("shard") == 3).cast("int")), "state-manifests")
    sources = each.where(_k() % 37 != 11).select(
        *sh.SHARD, *SECURITY, (F.col("rows") + (_k() % 14 == 2).cast("int")).alias("rows"),
        F.when(_k() % 18 != 4, F.sha2("code", 256)).alias("sha256"))
    day = F.lit("2000-02-01").cast("date").alias("trade_date")
    told = life.where("(k % 6 = 4 and k % 4 <> 0) or k % 29 = 3").select(*SECURITY, day)
    official = life.where("k % 6 = 4").select(*SECURITY, day)
    return summarize(sh.state_shards_gate(manifests, files, sources, state, life, told, official))


@query("ledger_fingerprint", "A12 N18 G5b", """
select 64 as digits, 1 as same_when_moved, 0 as same_when_changed, count(*) as actions from (
  select distinct floor(o_custkey / 15) as k, cast(o_orderdate as date) as d from orders)""")
def ledger_fingerprint(spark, sf):
    """One fingerprint of files and ledger: the same for rows in another order, another one for other rows."""
    ledger = stored(b.action_ledger(spark, sf), "ledger")
    files = ledger.groupBy(F.pmod(_k(), F.lit(8)).alias("shard")).agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("shard-"), F.col("shard").cast("string")).alias("file"), F.sha2(F.col("n").cast("string"), 256).alias("sha256"))
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in (*ac.ACTION_KEY, "action_type")])
    print_ = lambda rows: sh.shards_fingerprint(files, line, rows)
    moved = print_(ledger.repartition(5, "ex_date")).withColumnRenamed("fingerprint", "moved")
    changed = print_(ledger.withColumn("ex_date", F.date_add("ex_date", 1))).withColumnRenamed("fingerprint", "changed")
    rows = ledger.agg(F.count(F.lit(1)).alias("actions"))
    return sh.beside(print_(ledger), moved, changed, rows).select(
        F.length("fingerprint").alias("digits"), (F.col("fingerprint") == F.col("moved")).cast("int").alias("same_when_moved"),
        (F.col("fingerprint") == F.col("changed")).cast("int").alias("same_when_changed"), "actions")
