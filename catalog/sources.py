"""Scans and sinks: raw payloads, strict tables, partitions, manifests, digests.

Queries that write use a folder of their own below the shared folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import bindings as b
from catalog.bindings import RULES, with_ctes
from catalog.registry import plain, query
from pitgate.functions.text import first_nonempty
from pitgate.operators import bars as br
from pitgate.operators.blocks import last_before
from pitgate.operators.checks import beside, gather, summarize, violations
from pitgate.operators.joins import interval_join, missing_keys
from pitgate.operators.lifecycle import apply_transitions
from pitgate.plans import gates as gt
from pitgate.plans import stages
from pitgate.schema import BAR, SECURITY
from pitgate.sources import files as fl
from pitgate.sources import readers as rd
from pitgate.sources import writers as wr
from pitgate.sources.writers import stored

DAY = [*SECURITY, "trade_date"]
VALUES = ("open", "high", "low", "close", "volume_shares", "amount_cny")


def _folder(spark, name: str) -> str:
    return f"{wr.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "S1 S2 S3 S10 O1", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date, cast(open as double) as open, cast(high as double) as high,
  cast(low as double) as low, cast(close as double) as close, volume_shares, amount_cny from bars"""))
def csv_round_trip(spark, sf):
    path = _folder(spark, "bars-csv")
    wr.write_sorted_csv(b.bars(spark, sf).select(*BAR.fieldNames()), path, ["trade_date", "code"])
    return plain(rd.read_table(spark, path, BAR))


_NORMAL = """select b.exchange, b.code, cast(b.trade_date as varchar) as trade_date, cast(b.open as double) as open, cast(b.high as double) as high,
  cast(b.low as double) as low, cast(b.close as double) as close, b.volume_shares, b.amount_cny
from bars b join life l using (exchange, code)
where b.trade_date between date '1995-02-01' and date '2001-06-30' and b.trade_date >= l.listed_from
  and (l.listed_to_exclusive is null or b.trade_date < l.listed_to_exclusive)"""


def array_payloads(spark, sf):
    """One nested payload per code and year (at most a year of days in each)."""
    item = F.array(F.date_format("trade_date", "yyyyMMdd"), *[F.col(c).cast("string") for c in VALUES])
    rows = b.bars(spark, sf).withColumn("year", F.year("trade_date"))
    shown = F.when(F.col("code").cast("bigint") % 12 == 5, "wrong").otherwise(F.col("code"))
    return rows.groupBy(*SECURITY, "year").agg(F.array_sort(F.collect_list(item)).alias("kline")).select(
        *SECURITY, F.to_json(F.struct(
            shown.alias("code"), F.lit("0").alias("begin"), F.lit("1").alias("end"), "kline")).alias("payload"))


@query("nested_array_bars", "S7 C5 N1 N3 N4 J2", with_ctes(_NORMAL + " and cast(b.code as bigint) % 12 <> 5"))
def nested_array_bars(spark, sf):
    rows, _ = br.explode_array_payload(array_payloads(spark, sf))
    bars, _, _ = br.normalize_bars(rows, b.intervals(spark, sf), RULES)
    return plain(bars)


@query("nested_array_faults", "S7 C5 J3 W6", with_ctes("""
select 'code mismatch' as "check", 'error' as severity, count(*) as n_violations, min(k) as first_key, max(k) as last_key
from (select distinct exchange || ':' || code as k, year(trade_date) as y from bars where cast(code as bigint) % 12 = 5)
union all
select 'outside lifecycle', 'error', count(*), min(k), max(k) from (select b.exchange || ':' || b.code || ':' || cast(trade_date as varchar) as k
  from bars b join life l using (exchange, code) where cast(b.code as bigint) % 12 <> 5 and trade_date between date '1995-02-01' and date '2001-06-30'
  and (trade_date < listed_from or trade_date >= listed_to_exclusive))"""))
def nested_array_faults(spark, sf):
    rows, bad_payloads = br.explode_array_payload(array_payloads(spark, sf))
    _, bad_rows, _ = br.normalize_bars(rows, b.intervals(spark, sf), RULES)
    return summarize(bad_payloads.unionByName(bad_rows))


def day_tables(spark, sf):
    """The bars as full-market day tables in text: the second venue's rows as data with
    volume and money in ten thousands, the first venue's as placeholder rows."""
    wan = lambda c: (F.col(c) / 10000).cast("decimal(18,4)").cast("string")
    data = F.col("exchange") == "SZSE"
    day = F.col("trade_date").cast("string")
    shown = [F.when(data, day).otherwise("没有找到符合条件的数据！"), F.col("code"), F.lit("n"), F.lit("-"),
             *[F.format_string("%s", F.col(c).cast("string")) for c in ("open", "high", "low", "close")],
             F.lit("0"), wan("volume_shares"), wan("amount_cny"), F.lit("")]
    late = F.when(F.col("code").cast("bigint") % 14 == 6, F.date_add("trade_date", 1)).otherwise(F.col("trade_date"))
    return b.bars(spark, sf).select(
        *[c.alias(n) for c, n in zip(shown, br.DAY_TABLE_HEADER)], late.alias("requested_day"))


@query("day_table_bars", "S9 S3 C5 P6 N3", with_ctes(_NORMAL + " and exchange = 'SZSE' and cast(b.code as bigint) % 14 <> 6"))
def day_table_bars(spark, sf):
    table = rd.require_columns(day_tables(spark, sf), br.DAY_TABLE_HEADER)
    rows, _ = br.day_table_rows(table)
    bars, _, _ = br.normalize_bars(rows, b.intervals(spark, sf), RULES, unit=br.TEN_THOUSAND, outside="ignore")
    return plain(bars)


@query("bars_stage", "C5 S7 S9 U1", with_ctes(
    _NORMAL + """ and case when exchange = 'SSE' then cast(b.code as bigint) % 12 <> 5 else cast(b.code as bigint) % 14 <> 6 end"""))
def bars_stage(spark, sf):
    nested = array_payloads(spark, sf).where("exchange = 'SSE'")
    bars, _, _ = stages.bars_stage(nested, day_tables(spark, sf), b.intervals(spark, sf), RULES)
    return plain(bars)


@query("day_table_diagnostics", "C5 A14 J3", with_ctes("""
select exchange, code, count(*) as source_rows, count_if(i) as normalized_rows, count_if(not i) as ignored_rows
from (select b.*, b.trade_date >= l.listed_from and (l.listed_to_exclusive is null or b.trade_date < l.listed_to_exclusive) as i
  from bars b join life l using (exchange, code)
  where exchange = 'SZSE' and cast(b.code as bigint) % 14 <> 6 and trade_date between date '1995-02-01' and date '2001-06-30') group by 1, 2"""))
def day_table_diagnostics(spark, sf):
    rows, _ = br.day_table_rows(day_tables(spark, sf))
    _, _, seen = br.normalize_bars(rows, b.intervals(spark, sf), RULES, unit=br.TEN_THOUSAND, outside="ignore")
    return seen.select(*SECURITY, "source_rows", "normalized_rows", "ignored_rows")


@query("jsonp_payload_rows", "S6 N9", """
select page, case when length(c_custkey::varchar) < 6 then lpad(c_custkey::varchar, 6, '0') else c_custkey::varchar end as code,
  c_name as name, case when c_mktsegment <> 'MACHINERY' then c_mktsegment end as board
from (select *, cast(floor(c_custkey / 50) as bigint) as page from customer)""")
def jsonp_payload_rows(spark, sf):
    row = F.struct(b.code6(F.col("c_custkey")).alias("A_STOCK_CODE"), F.col("c_name").alias("COMPANY_ABBR"),
                   F.when(F.col("c_mktsegment") == "MACHINERY", "-").otherwise(F.col("c_mktsegment")).alias("LIST_BOARD"))
    page = F.floor(F.col("c_custkey") / 50).cast("bigint")
    docs = b.table(spark, sf, "customer").groupBy(page.alias("page")).agg(F.collect_list(row).alias("rows"))
    body = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.col("rows").alias("result")))).otherwise(
        F.to_json(F.struct(F.array().cast("array<string>").alias("result"), F.col("rows").alias("data"))))
    payloads = docs.select("page", F.when(F.col("page") % 3 == 0, body).otherwise(
        F.concat(F.lit("jsonpCallback12("), body, F.lit(");\n"))).alias("payload"))
    rows = rd.payload_rows(payloads, "payload", ["A_STOCK_CODE", "COMPANY_ABBR", "LIST_BOARD"])
    return rows.select("page", F.col("A_STOCK_CODE").alias("code"), F.col("COMPANY_ABBR").alias("name"),
                       first_nonempty(F.col("LIST_BOARD")).alias("board"))


def _part_pages(spark, sf):
    """Parts as nested pages of forty: every third part sits one level deeper."""
    flat = F.struct(b.code6(F.col("p_partkey")).alias("agdm"), F.col("p_name").alias("agjc"))
    nested = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.array(F.struct(flat.alias("x"))).alias("deep")))).otherwise(F.to_json(flat))
    docs = b.table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 40).cast("bigint").alias("page")).agg(
        F.collect_list(nested).alias("rows"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit('{"metadata":{"catalogid":"1110","recordcount":'), (F.col("n") + (F.col("page") % 5 == 4).cast("int")).cast("string"),
                    F.lit('},"data":['), F.array_join("rows", ","), F.lit("]}"))
    return docs.select("page", text.alias("payload"))


@query("json_object_walk", "S8", """
select cast(floor(p_partkey / 40) as bigint) as page, case when length(p_partkey::varchar) < 6 then lpad(p_partkey::varchar, 6, '0') else p_partkey::varchar end as code,
  p_name as name from part""")
def json_object_walk(spark, sf):
    found = rd.objects_with_key(_part_pages(spark, sf), "payload", "agdm")
    return found.select("page", F.get_json_object("object_json", "$.agdm").alias("code"),
                        F.get_json_object("object_json", "$.agjc").alias("name"))


@query("page_completeness", "A17 S8", """
select cast(floor(p_partkey / 40) as bigint) as page, count(*) as found, count(*) + case when cast(floor(p_partkey / 40) as bigint) % 5 = 4 then 1 else 0 end as declared,
  case when cast(floor(p_partkey / 40) as bigint) % 5 = 4 then 0 else 1 end as complete from part group by cast(floor(p_partkey / 40) as bigint)""")
def page_completeness(spark, sf):
    pages = _part_pages(spark, sf)
    found = rd.objects_with_key(pages, "payload", "agdm").groupBy("page").agg(
        F.count_distinct(F.get_json_object("object_json", "$.agdm")).alias("found"))
    meta = rd.objects_with_key(pages, "payload", "catalogid").where(
        F.get_json_object("object_json", "$.catalogid") == "1110").select(
        "page", F.get_json_object("object_json", "$.recordcount").cast("bigint").alias("declared"))
    joined = meta.join(found, "page", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return plain(joined.withColumn("complete", F.col("found") == F.col("declared")))


@query("json_array_scan", "S5", """
select s_suppkey, s_name, s_nationkey as nation from supplier""")
def json_array_scan(spark, sf):
    """Suppliers as JSON files, each one array of at most 500 objects."""
    path = _folder(spark, "arrays")
    row = F.struct("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    pages = b.table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 500).alias("page")).agg(
        F.to_json(F.collect_list(row)).alias("value"))
    pages.write.partitionBy("page").text(path)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
                           T.StructField("nation", T.IntegerType())])
    return rd.read_json_array(spark, f"{path}/*/*.txt", schema)


@query("header_aliases", "S4", """
select case when length(p_partkey::varchar) < 6 then lpad(p_partkey::varchar, 6, '0') else p_partkey::varchar end as code, p_type as board from part""")
def header_aliases(spark, sf):
    sheet = b.table(spark, sf, "part").select(
        F.col("p_name").alias("公司简称"), b.code6(F.col("p_partkey")).alias("A股 代码"), F.col("p_type").alias("所属板块"))
    return rd.resolve_headers(sheet, {"code": ["A股代码", "证券代码", "股票代码"], "board": ["板块", "所属板块", "市场板块"]},
                              required=["code", "board"])


@query("year_partition_rewrite", "S11 S13 C22", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date, cast(case when year(trade_date) in (1997, 1998) and k % 10 = 3 then close + 1 else close end as double) as close
from bars join (select exchange, code, k from life) using (exchange, code)"""))
def year_partition_rewrite(spark, sf):
    path = _folder(spark, "bars-years")
    wr.write_years(b.bars(spark, sf), path, "trade_date", ["trade_date", "code"])
    stored = spark.read.parquet(path).drop("year")
    codes = b.transitions(spark, sf).select("exchange", F.col("new_code").alias("code"))
    rebuilt = b.bars(spark, sf).join(codes, list(SECURITY), "left_semi").withColumn("close", F.col("close") + 1)
    replaced = br.replace_securities(stored, rebuilt, [1997, 1998])
    wr.rewrite_years(replaced, path, "trade_date", ["trade_date", "code"])
    return plain(spark.read.parquet(path).select(*DAY, "close"))


@query("transition_repair", "C22", with_ctes("""
select b.exchange, case when b.trade_date < t.effective_date then t.old_code else t.new_code end as code, cast(b.trade_date as varchar) as trade_date, cast(b.close as double) as close
from bars b join transitions t on t.exchange = b.exchange and t.new_code = b.code join life l on l.exchange = b.exchange and l.code = b.code
where b.trade_date >= l.listed_from and year(b.trade_date) in (1997, 1998)
union all
select b.exchange, b.code, cast(b.trade_date as varchar), cast(b.close as double) from bars b
where year(b.trade_date) in (1997, 1998) and not exists (select 1 from transitions t where t.exchange = b.exchange and t.new_code = b.code)"""))
def transition_repair(spark, sf):
    lives = stored(b.life(spark, sf), "life")
    changes = b.transitions_of(lives)
    split, _ = apply_transitions(lives.drop("k"), changes)
    bars = stored(b.bars(spark, sf), "bars")
    text = bars.select(*DAY, *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
                       F.col("volume_shares").cast("string").alias("volume"), F.col("amount_cny").cast("string").alias("amount"))
    # The successor's source also carries its history under the old code.
    successor = text.join(changes.select("exchange", F.col("new_code").alias("code"), "old_code"), list(SECURITY))
    both = successor.withColumn("code", F.explode(F.array("code", "old_code"))).drop("old_code")
    repaired, _ = br.repair_transition(both, bars, split, changes, RULES, [1997, 1998])
    return plain(repaired.select(*DAY, "close"))


@query("transition_repair_faults", "C22 G3i", with_ctes("""
select "check", exchange || ':' || old_code || ':' || new_code as key, cast(effective_date as varchar) as detail
from (select t.*, (select min(b.trade_date) from bars b where b.exchange = t.exchange and b.code = t.new_code and b.trade_date >= t.effective_date) as first_new,
    (select count(*) from bars b, life l where l.exchange = t.exchange and l.code = t.new_code and b.exchange = t.exchange and b.code = t.new_code and b.trade_date < t.effective_date and b.trade_date >= l.listed_from) as old_bars
  from transitions t), lateral (select unnest(list_filter([case when old_bars = 0 then 'predecessor has zero bars' end, case when first_new is null then 'successor has zero bars' end,
    case when first_new <> effective_date then 'successor first bar is not the effective date' end], lambda x: x is not null)) as "check")"""))
def transition_repair_faults(spark, sf):
    changes = b.transitions(spark, sf)
    split, _ = apply_transitions(b.intervals(spark, sf), changes)
    source = b.bars(spark, sf)
    own = changes.select("exchange", F.col("new_code").alias("code"), "old_code")
    twice = source.join(own, list(SECURITY)).withColumn("code", F.explode(F.array("code", "old_code"))).drop("old_code")
    inside = interval_join(twice, split.select(*SECURITY, "listed_from", "listed_to_exclusive"), "trade_date", RULES)
    return br.transition_bar_checks(inside, changes)[1]


@query("manifest_round_trip", "S14 S16 J15 A14 A19", with_ctes("""
select exchange, year(trade_date) as year, count(*) as data_rows, count(*) + case when year(trade_date) = 1999 then 1 else 0 end as declared_rows,
  cast(year(trade_date) <> 1999 as integer) as accounted from bars group by 1, 2"""))
def manifest_round_trip(spark, sf):
    path = _folder(spark, "manifests")
    counts = b.bars(spark, sf).groupBy("exchange", F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.concat_ws("_", "exchange", F.col("year").cast("string")).alias("file"), "year",
                     (F.col("n") + (F.col("year") == 1999).cast("int")).alias("rows"))
    sidecars = counts.groupBy("exchange").agg(F.sort_array(F.collect_list(entry)).alias("files"))
    sidecars.select(F.col("exchange").alias("venue"), "exchange", "files").repartition("venue").write.partitionBy("venue").json(path)
    schema = T.StructType.fromDDL("exchange STRING, files ARRAY<STRUCT<file: STRING, year: INT, rows: BIGINT>>")
    declared = rd.manifest_entries(rd.read_manifests(spark, f"{path}/*/*.json", schema), "files")
    joined = counts.withColumnRenamed("n", "data_rows").join(
        declared.select("exchange", "year", F.col("rows").alias("declared_rows")), ["exchange", "year"], "full_outer")
    return plain(joined.withColumn("accounted", F.col("data_rows").eqNullSafe(F.col("declared_rows"))))


@query("file_digest_check", "S15 S17 A20", with_ctes("""
select count(*) as "rows", 0 as unregistered, 0 as mismatched, 1 as some_files from bars"""))
def file_digest_check(spark, sf):
    data, listed = _folder(spark, "digested"), _folder(spark, "sums")
    wr.write_sorted_csv(b.bars(spark, sf).select(*BAR.fieldNames()), data, ["trade_date", "code"])
    actual = rd.file_digests(spark, f"{data}/*.csv.gz")
    actual.select(F.concat_ws("  ", "sha256", "file").alias("value")).write.text(listed)
    registered = rd.read_digest_list(spark, listed)
    joined = actual.join(registered.select(F.col("name").alias("file"), F.col("sha256").alias("registered")), "file", "left")
    files = joined.agg(
        F.count_if(F.col("registered").isNull()).alias("unregistered"),
        F.count_if(F.col("registered") != F.col("sha256")).alias("mismatched"),
        (F.count(F.lit(1)) > 0).alias("some_files"))
    rows = rd.read_table(spark, data, BAR).agg(F.count(F.lit(1)).alias("rows"))
    return plain(beside(rows, files))


@query("sorted_partitions", "S10 S12 O1", with_ctes("""
select exchange, count(*) as "rows", 0 as descents, cast(min(trade_date) as varchar) as first_day from bars group by 1"""))
def sorted_partitions(spark, sf):
    """Files written in order hold no descent inside a file."""
    path = _folder(spark, "sorted")
    wr.write_years(b.bars(spark, sf), path, "trade_date", ["trade_date", "code"])
    rows = spark.read.parquet(path)
    placed = rows.select("exchange", "code", "trade_date", F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.row_index").alias("position"))
    key = F.concat_ws(":", F.col("trade_date").cast("string"), "code")
    linked = last_before(placed.withColumn("key", key), ["exchange", "file"], "position", F.col("key"), "previous",
                         block=lambda position: F.floor(position / 65536))
    return plain(linked.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key") <= F.col("previous")).alias("descents"),
        F.min("trade_date").alias("first_day")))


def _year_files(bars, path):
    """A compressed file for each venue and year, in order; equal rows give equal bytes."""
    dated = bars.withColumn("year", F.year("trade_date"))
    keys = ["exchange", "year"]
    arranged = dated.repartition(*keys).sortWithinPartitions(*keys, "trade_date", "code")
    write = arranged.select(*[c for c in dated.columns if c not in keys], *keys).write.option("header", True)
    write.option("compression", "gzip").mode("append").partitionBy(*keys).csv(path)


IN_FILE = ["code", "trade_date", *VALUES]


def _faulty_year_files(spark, sf):
    """Bars by venue and year: one year runs backwards, one has another header, and one is of no venue."""
    path = _folder(spark, "bars-by-year")
    bars = b.bars(spark, sf).withColumn("year", F.year("trade_date"))
    backwards, renamed = "(exchange = 'SSE' and year = 1997)", "(exchange = 'SZSE' and year = 1998)"
    _year_files(bars.where(f"not {backwards} and not {renamed}").drop("year"), path)
    _year_files(bars.where(renamed).drop("year").withColumnRenamed("code", "number"), path)
    bars.where(backwards).repartition(1).sortWithinPartitions(
        "exchange", "year", F.desc("trade_date"), F.desc("code")).select(
        *IN_FILE, "exchange", "year").write.option("header", True).option("compression", "gzip").mode("append").partitionBy(
        "exchange", "year").csv(path)
    orders = fl.csv_orders(spark, path, IN_FILE, ["trade_date", "code"])
    return orders.withColumns({c: fl.partition_value("file", c) for c in ("exchange", "year")})


@query("bar_file_orders", "G3 W6 S1", with_ctes("""
select exchange, cast(year(trade_date) as varchar) as year, count(*) as "rows",
  case when exchange = 'SZSE' and year(trade_date) = 1998 then 0 else 1 end as header_ok,
  case when exchange = 'SSE' and year(trade_date) = 1997 then count(*) - 1 else 0 end as descents,
  case when exchange = 'SSE' and year(trade_date) = 1997 then cast(max(trade_date) as varchar) else cast(min(trade_date) as varchar) end as first_day
from bars group by exchange, year(trade_date)"""))
def bar_file_orders(spark, sf):
    """Header and order of each file, tested in one pass over its blocks."""
    orders = _faulty_year_files(spark, sf)
    return plain(orders.select("exchange", "year", "rows", "header_ok", "descents",
                               F.split("first_key", "\x1f")[0].alias("first_day")))


@query("gate_bar_files", "G3 W6", with_ctes("""
select 'unexpected header' as "check", exchange || ':' || year as key, '' as detail from f where exchange = 'SZSE' and year = 1998
union all select 'key does not rise in its file', exchange || ':' || year, (select cast(trade_date as varchar) || ':' || code from (
    select trade_date, code, row_number() over (order by trade_date desc, code desc) as i from bars where exchange = 'SSE' and year(trade_date) = 1997) where i = 2)
  from f where exchange = 'SSE' and year = 1997
union all select 'year without data file', exchange || ':' || year, '' from (select * from y except select exchange, year from f)
union all select 'data file outside the coverage', exchange || ':' || year, '' from (select exchange, year from f except select * from y)""",
    ("f", "select exchange, year(trade_date) as year from bars group by 1, 2"),
    ("y", "select e as exchange, y as year from (values ('SSE'), ('SZSE')) v(e), range(1995, 2002) r(y)")))
def gate_bar_files(spark, sf):
    return gt.bar_files_gate(stored(_faulty_year_files(spark, sf), "file-orders"), RULES)


@query("file_digest_faults", "S15 S17 A20 G3", with_ctes("""
select 'evidence digest mismatch' as "check", 'exchange=SSE/year=1997' as key from bars where exchange = 'SSE' and year(trade_date) = 1997 group by 1, 2
union all select 'evidence missing', 'exchange=SZSE/year=1998' from bars where exchange = 'SZSE' and year(trade_date) = 1998 group by 1, 2
union all select 'file without registered digest', 'exchange=OTHER/year=1996' from bars where exchange = 'SSE' and year(trade_date) = 1996 group by 1, 2"""))
def file_digest_faults(spark, sf):
    """Digests kept from before against files written anew: one altered, one missing, one more than listed."""
    kept, later, listed = (_folder(spark, name) for name in ("files-kept", "files-later", "sums"))
    bars = stored(b.bars(spark, sf), "bars").withColumn("year", F.year("trade_date"))
    named = lambda path: fl.digests(spark, path).select(
        F.concat(F.lit("exchange="), fl.partition_value("path", "exchange"), F.lit("/year="),
                 fl.partition_value("path", "year")).alias("key"), "sha256")
    _year_files(bars.drop("year"), kept)
    named(kept).select(F.concat_ws("  ", "sha256", "key").alias("value")).write.text(listed)
    more = F.when((F.col("exchange") == "SSE") & (F.col("year") == 1997), 1).otherwise(0)
    other = bars.where("exchange = 'SSE' and year = 1996").withColumn("exchange", F.lit("OTHER"))
    moved = bars.where("not (exchange = 'SZSE' and year = 1998)").withColumn("amount_cny", F.col("amount_cny") + more)
    _year_files(moved.unionByName(other).drop("year"), later)
    registered, actual = rd.read_digest_list(spark, listed).withColumnRenamed("name", "key"), stored(named(later), "digests")
    return gather(
        gt.digest_violations(registered, actual, "key"),
        violations(missing_keys(actual, registered, ["key"]), "file without registered digest", F.col("key"))).select("check", "key")
