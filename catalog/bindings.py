"""The domain tables, read out of the star-schema test tables.

Each function builds one domain table as a DataFrame from the whole of its source tables;
``CTES`` states the same tables in SQL for the comparison.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitgate.operators.blocks import scattered, strict_asof
from pitgate.operators.joins import lifecycle_status
from pitgate.operators.trading_days import security_days, venue_days
from pitgate.schema import SECURITY, Rules

RULES = Rules(
    coverage_start=dt.date(1995, 2, 1),
    coverage_end=dt.date(2001, 6, 30),
    ipo_2014_start=dt.date(1995, 1, 1),
    registration_start=dt.date(1995, 7, 1),
    risk_warning_10pct_start=dt.date(1998, 1, 1),
    delisting_reform=dt.date(1999, 11, 15),
)
PRICE = "decimal(18,6)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code6(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def venue(number: Column) -> Column:
    return F.when(number % 2 == 1, F.lit("SSE")).otherwise(F.lit("SZSE"))


def px(spark, sf) -> DataFrame:
    """One row per trade: a line item priced for its supplier's code."""
    k = F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        venue(k).alias("exchange"), code6(k).alias("code"), k.alias("k"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("p"),
        F.col("l_quantity").cast("bigint").alias("q"),
        "l_orderkey", "l_linenumber", "l_partkey")


def bars(spark, sf) -> DataFrame:
    position = F.struct("l_orderkey", "l_linenumber", "l_partkey", "q", "p")
    # Grouped by the number; the two text keys are made of it once per group.
    grouped = px(spark, sf).groupBy("k", "trade_date").agg(
        F.min(position)["p"].cast(PRICE).alias("open"),
        F.max("p").cast(PRICE).alias("high"), F.min("p").cast(PRICE).alias("low"),
        F.max(position)["p"].cast(PRICE).alias("close"),
        F.sum("q").alias("volume_shares"),
        F.sum((F.col("p") * 100).cast("bigint")).alias("amount_cny"))
    return grouped.select(
        venue(F.col("k")).alias("exchange"), code6(F.col("k")).alias("code"), "trade_date", "open",
        "high", "low", "close", "volume_shares", "amount_cny")


def life(spark, sf) -> DataFrame:
    """One interval per code; every fifth ends, and listing lags the first trade by code."""
    grouped = px(spark, sf).groupBy("k").agg(F.min("trade_date").alias("_first"))
    spans = grouped.withColumns({"exchange": venue(F.col("k")), "code": code6(F.col("k"))})
    ends = F.when(F.col("k") % 5 == 0, F.lit(dt.date(2000, 1, 1)))
    return spans.select(
        "exchange", "code", "k", F.concat(F.lit("S"), "code").alias("name"),
        F.date_add("_first", (F.col("k") % 7 * 40).cast("int")).alias("listed_from"),
        ends.alias("listed_to_exclusive"),
        F.lit("RETROSPECTIVE_PRIMARY").alias("list_evidence_class"),
        F.when(F.col("k") % 5 == 0, F.lit("RETROSPECTIVE_PRIMARY")).alias("delist_evidence_class"))


def intervals(spark, sf) -> DataFrame:
    return life(spark, sf).drop("k")


def transitions(spark, sf) -> DataFrame:
    return transitions_of(life(spark, sf))


def transitions_of(lives: DataFrame) -> DataFrame:
    k = F.col("k")
    return lives.where(k % 10 == 3).select(
        "exchange", code6(k + 900000).alias("old_code"), F.col("code").alias("new_code"),
        F.date_add(F.lit(dt.date(1998, 6, 1)), (k % 50).cast("int")).alias("effective_date"),
        F.concat(F.lit("O"), "code").alias("old_name"), F.concat(F.lit("N"), "code").alias("new_name"),
        F.lit("").alias("source_url"), F.sha2(F.col("code"), 256).alias("source_sha256"),
        F.lit("POINT_IN_TIME_PRIMARY").alias("evidence_class"))


def lifecycle_events(spark, sf) -> DataFrame:
    """LIST, RENAME and DELIST events, with faulty sequences for some codes."""
    k, start = F.col("k"), F.col("listed_from")

    def event(kind, day, name, when):
        return F.when(when, F.struct(F.lit(kind).alias("event_type"), day.alias("effective_date"),
                                     name.alias("name")))

    none = F.lit("")
    listed = F.array_compact(F.array(
        event("LIST", start, F.col("name"), F.lit(True)),
        event("RENAME", F.date_add(start, 200), F.concat(F.lit("R"), "code"), k % 3 == 0),
        event("DELIST", F.col("listed_to_exclusive"), none, k % 5 == 0),
        event("LIST", F.date_add(start, 100), F.col("name"), k % 11 == 7),
        event("DELIST", F.date_sub(start, 10), none, k % 13 == 5),
        event("DELIST", start, none, k % 17 == 9),
        event("RENAME", F.date_add(F.col("listed_to_exclusive"), 5), F.col("name"), (k % 5 == 0) & (k % 4 == 2)),
        event("LIST", F.date_add(F.col("listed_to_exclusive"), 90), F.concat(F.lit("B"), "code"),
              (k % 5 == 0) & (k % 4 == 1)),
    ))
    return life(spark, sf).select("exchange", "code", F.explode(listed).alias("e")).select(
        "exchange", "code", "e.*", F.lit("u").alias("source_url"),
        F.sha2(F.col("code"), 256).alias("source_sha256"),
        F.lit("RETROSPECTIVE_PRIMARY").alias("evidence_class"))


def state_days(spark, sf, lives: DataFrame | None = None) -> DataFrame:
    """A row per security and trading day of its life, with the day's close if it traded."""
    b = bars(spark, sf)
    lives = life(spark, sf) if lives is None else lives
    days = security_days(lives.select(*SECURITY, "k", "listed_from", "listed_to_exclusive"),
                         venue_days(b), RULES.coverage_start, RULES.coverage_end)
    keys = [*SECURITY, "trade_date"]
    # Where only traded days are read on, the join is an inner one, and Spark, which does not count what explode adds,
    # takes the days for as small as their lives and would broadcast them.
    return scattered(scattered(days, *keys).hint("merge").join(b.select(*keys, "close"), keys, "left"), *SECURITY)


def state(spark, sf, lives: DataFrame | None = None) -> DataFrame:
    """Daily state; a day without a bar is a suspension."""
    joined = state_days(spark, sf, lives)
    # One row per security and day by construction, so a plain window will do here.
    before = (Window.partitionBy(*SECURITY).orderBy("trade_date")
              .rowsBetween(Window.unboundedPreceding, -1))
    known = joined.withColumn("preclose", F.last("close", ignorenulls=True).over(before))
    change = (F.col("close").cast("double") - F.col("preclose").cast("double")) * 100
    return known.select(
        *SECURITY, "trade_date", F.col("close").isNotNull().alias("tradable"),
        (F.col("k") % 9 == 0).alias("risk_warning"), "preclose",
        (change / F.col("preclose").cast("double")).alias("pct_chg"), "k")


def action_ledger(spark, sf) -> DataFrame:
    """One action per code and day of the orders."""
    k = F.floor(F.col("o_custkey") / 15).cast("bigint")
    orders = table(spark, sf, "orders").select(
        k.alias("k"), F.col("o_orderdate").cast("date").alias("ex_date"), "o_orderkey")
    grouped = orders.groupBy("k", "ex_date").agg(
        (F.sum(F.col("o_orderkey") % 50).cast("decimal(12,2)") / 100).cast(PRICE).alias("cash_per_share"),
        F.max(F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("_share"),
        F.max(F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)).alias("_rights"),
        F.count(F.lit(1)).cast("int").alias("source_count"))
    half = F.when(F.col("_share") == 1, F.lit("0.5")).otherwise(F.lit("0")).cast(PRICE)
    rights = F.when(F.col("_rights") == 1, F.lit("0.3")).otherwise(F.lit("0")).cast(PRICE)
    tags = F.concat_ws("+", F.when(F.col("cash_per_share") > 0, "CASH_DIVIDEND"),
                       F.when(F.col("_share") == 1, "CAPITAL_TRANSFER"),
                       F.when(F.col("_rights") == 1, "RIGHTS_ISSUE"))
    return grouped.select(
        venue(F.col("k")).alias("exchange"), code6(F.col("k")).alias("code"), "ex_date",
        tags.alias("action_type"), "cash_per_share", F.lit("0").cast(PRICE).alias("bonus_per_share"),
        half.alias("transfer_per_share"), rights.alias("rights_per_share"),
        F.when(F.col("_rights") == 1, F.lit("5")).otherwise(F.lit("0")).cast(PRICE).alias("rights_price"),
        "source_count", "k")


def action_state(spark, sf, ledger: DataFrame | None = None, closes: DataFrame | None = None) -> DataFrame:
    """The market's preclose on action days: the prior close for even codes, half of it for odd."""
    ledger = action_ledger(spark, sf) if ledger is None else ledger
    keys = ledger.select(*SECURITY, F.col("ex_date").alias("trade_date"), "k")
    priced = strict_asof(keys, bars(spark, sf) if closes is None else closes, SECURITY, "trade_date", "trade_date", ["close"], prefix="p_", block=None)
    close = F.col("p_close").cast("double")
    return priced.select(
        *SECURITY, "trade_date", (F.col("k") % 3 == 0).alias("tradable"),
        F.when(F.col("k") % 2 == 0, close).otherwise(close / 2).alias("preclose"))


def closes(spark, sf) -> DataFrame:
    """The bars' closes only, for steps that store them and read them several times."""
    return bars(spark, sf).select(*SECURITY, "trade_date", "close")


# A supplier's code holds fifteen customers; each order is one action component of it.
KIND = {"1-URGENT": "cash", "2-HIGH": "bonus", "3-MEDIUM": "transfer",
        "4-NOT SPECIFIED": "rights", "5-LOW": "cash"}
HOLDERS = "每十股：流通股股东派1.75元，限售股股东派1.4元"


def _components(spark, sf, control: bool) -> DataFrame:
    key = F.col("o_orderkey")
    k = F.floor(F.col("o_custkey") / 15).cast("bigint")
    o = table(spark, sf, "orders").withColumn("k", k).withColumn(
        "kind", F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])[F.col("o_orderpriority")])
    base = (F.lit(1) + key % 50).cast("decimal(12,2)") / 100
    if control:
        o = o.where("o_orderstatus <> 'P'")
        shifts = F.array_compact(F.array(
            F.when(key % 11 == 0, F.lit("0.01")).otherwise(F.lit("0")),
            F.when(key % 17 == 0, F.lit("0.20"))))
        o = o.withColumn("_shift", F.explode(shifts)).withColumn("copy", F.col("_shift"))
        amount = (base + F.col("_shift").cast("decimal(12,2)")).cast(PRICE)
        component = (F.when(F.col("kind") == "cash", "DIVIDEND").when(F.col("kind") == "rights", "RIGHTS")
                     .otherwise("BONUS"))
        system, shown = "SSE", F.concat(F.lit("c"), key.cast("string"), F.lit(":"), F.col("_shift"))
    else:
        o = o.where("not (o_orderstatus = 'F' and o_orderpriority = '2-HIGH')")
        copies = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        o = o.withColumn("copy", F.explode(copies))
        amount = base.cast(PRICE)
        component = F.when(F.col("kind") == "rights", "RIGHTS").otherwise("DIVIDEND_BONUS_TRANSFER")
        text = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(HOLDERS)).otherwise(F.lit("10派1元"))
        system = "CNINFO"
        shown = F.concat(F.lit('{"F007V":"'), text, F.lit('","k":'), key.cast("string"), F.lit("}"))
    zero = F.lit("0").cast(PRICE)
    of = lambda name: F.when(F.col("kind") == name, amount).otherwise(zero)
    day = F.col("o_orderdate").cast("date")
    no_day = F.lit(None).cast("date")
    return o.select(
        venue(F.col("k")).alias("exchange"), code6(F.col("k")).alias("code"), day.alias("ex_date"),
        F.date_sub(day, (key % 3).cast("int") + 1).alias("record_date"),
        (no_day if control else F.date_sub(day, 30)).alias("announcement_date"),
        component.alias("action_component"), of("cash").alias("cash_per_share"),
        of("bonus").alias("bonus_per_share"), of("transfer").alias("transfer_per_share"),
        of("rights").alias("rights_per_share"),
        F.when(F.col("kind") == "rights", (F.lit(5) + key % 7).cast(PRICE)).otherwise(zero).alias("rights_price"),
        F.when(F.col("kind") == "rights", F.date_add(day, 20)).alias("rights_listing_date"),
        F.lit(system).alias("source_system"), F.lit("orders").alias("source_id"),
        F.lit("u").alias("source_url"), F.sha2(key.cast("string"), 256).alias("source_sha256"),
        shown.alias("source_payload"))


def components(spark, sf) -> DataFrame:
    return _components(spark, sf, control=False)


def control_components(spark, sf) -> DataFrame:
    return _components(spark, sf, control=True)


def _numbered_ledger(spark, sf, ledger: DataFrame | None = None) -> DataFrame:
    """Actions numbered per code; a code has at most one action a day of the calendar."""
    w = Window.partitionBy(*SECURITY).orderBy("ex_date")
    ledger = action_ledger(spark, sf) if ledger is None else ledger
    return ledger.select(*SECURITY, "ex_date", "action_type", "k").withColumn(
        "rn", F.row_number().over(w).cast("double"))


def official_chain(spark, sf, ledger: DataFrame | None = None) -> DataFrame:
    rn = F.col("rn")
    ratio = (F.lit(1.0) + F.lit(0.05) * rn) / (F.lit(1.0) + F.lit(0.05) * (rn - 1))
    off = F.when(rn.cast("bigint") % 17 == 0, ratio * 1.02).when(
        rn.cast("bigint") % 19 == 0, F.lit(1.0004)).otherwise(ratio)
    return _numbered_ledger(spark, sf, ledger).select(
        *SECURITY, "ex_date", "action_type", off.alias("back_adjust_multiplier"))


def factors(spark, sf, ledger: DataFrame | None = None) -> DataFrame:
    """Supplier factor rows: days shifted by code, some missing, some rebased."""
    rn, n = F.col("rn"), F.col("rn").cast("bigint")
    back = F.lit(1.0) + F.lit(0.05) * rn
    fore = F.when(n % 9 == 0, back * 3).otherwise(back)
    return _numbered_ledger(spark, sf, ledger).where(n % 7 != 0).select(
        *SECURITY, F.date_add("ex_date", (F.col("k") % 5).cast("int")).alias("effective_date"),
        fore.alias("fore_adjust_factor"), F.when(n % 23 == 0, F.lit(0.0)).otherwise(back).alias("back_adjust_factor"),
        back.alias("adjust_factor"))


def whitelist(spark, sf, ledger: DataFrame | None = None, closes: DataFrame | None = None) -> DataFrame:
    """Actions of codes that have no earlier bar, with the price their filing states."""
    ledger = action_ledger(spark, sf) if ledger is None else ledger
    priced = strict_asof(ledger, bars(spark, sf) if closes is None else closes, SECURITY, "ex_date", "trade_date", ["close"], block=None)
    return priced.where("prior_close is null").select(*SECURITY, "ex_date")


def status_rows(spark, sf, source: DataFrame, day: str) -> DataFrame:
    return lifecycle_status(source, intervals(spark, sf), day, RULES)


# ---------------------------------------------------------------------------------------
# The same tables in SQL. Each entry may use the ones before it.

_CODE6 = "case when length(cast({0} as varchar)) < 6 then lpad(cast({0} as varchar), 6, '0') else cast({0} as varchar) end"
_VENUE = "case when {0} % 2 = 1 then 'SSE' else 'SZSE' end"


def sql_code6(expr: str) -> str:
    return _CODE6.format(f"({expr})")


def sql_venue(expr: str) -> str:
    return _VENUE.format(f"({expr})")


_KIND_SQL = ("case o_orderpriority when '1-URGENT' then 'cash' when '2-HIGH' then 'bonus' "
             "when '3-MEDIUM' then 'transfer' when '4-NOT SPECIFIED' then 'rights' else 'cash' end")

CTES: dict[str, str] = {
    "px": f"""select {sql_venue('l_suppkey')} as exchange, {sql_code6('l_suppkey')} as code, l_suppkey as k,
        cast(l_shipdate as date) as trade_date, cast(l_extendedprice as decimal(12,2)) as p,
        cast(l_quantity as bigint) as q, l_orderkey, l_linenumber, l_partkey from lineitem""",
    "bars": """select exchange, code, trade_date,
        cast(arg_min(p, row(l_orderkey, l_linenumber, l_partkey, q, p)) as decimal(18,6)) as open,
        cast(max(p) as decimal(18,6)) as high, cast(min(p) as decimal(18,6)) as low,
        cast(arg_max(p, row(l_orderkey, l_linenumber, l_partkey, q, p)) as decimal(18,6)) as close,
        cast(sum(q) as bigint) as volume_shares, cast(sum(cast(p * 100 as bigint)) as bigint) as amount_cny
        from px group by exchange, code, trade_date""",
    "life": """select exchange, code, k, 'S' || code as name,
        min(trade_date) + cast(k % 7 * 40 as integer) as listed_from,
        case when k % 5 = 0 then date '2000-01-01' end as listed_to_exclusive,
        'RETROSPECTIVE_PRIMARY' as list_evidence_class,
        case when k % 5 = 0 then 'RETROSPECTIVE_PRIMARY' end as delist_evidence_class
        from px group by exchange, code, k""",
    "transitions": f"""select exchange, {sql_code6('k + 900000')} as old_code, code as new_code,
        date '1998-06-01' + cast(k % 50 as integer) as effective_date, 'O' || code as old_name,
        'N' || code as new_name, sha256(code) as source_sha256, 'POINT_IN_TIME_PRIMARY' as evidence_class
        from life where k % 10 = 3""",
    "lifecycle_events": """select exchange, code, k, 'LIST' as event_type, listed_from as effective_date, name from life
        union all select exchange, code, k, 'RENAME', listed_from + 200, 'R' || code from life where k % 3 = 0
        union all select exchange, code, k, 'DELIST', listed_to_exclusive, '' from life where k % 5 = 0
        union all select exchange, code, k, 'LIST', listed_from + 100, name from life where k % 11 = 7
        union all select exchange, code, k, 'DELIST', listed_from - 10, '' from life where k % 13 = 5
        union all select exchange, code, k, 'DELIST', listed_from, '' from life where k % 17 = 9
        union all select exchange, code, k, 'RENAME', listed_to_exclusive + 5, name from life where k % 5 = 0 and k % 4 = 2
        union all select exchange, code, k, 'LIST', listed_to_exclusive + 90, 'B' || code from life where k % 5 = 0 and k % 4 = 1""",
    "days": "select distinct trade_date from bars",
    "state": """select l.exchange, l.code, l.k, d.trade_date, b.close is not null as tradable, l.k % 9 = 0 as risk_warning,
        last_value(b.close ignore nulls) over w as preclose,
        (cast(b.close as double) - cast(last_value(b.close ignore nulls) over w as double)) * 100
          / cast(last_value(b.close ignore nulls) over w as double) as pct_chg,
        l.listed_from, l.listed_to_exclusive
        from life l join days d on d.trade_date >= greatest(l.listed_from, date '1995-02-01')
          and d.trade_date <= date '2001-06-30'
          and (l.listed_to_exclusive is null or d.trade_date < l.listed_to_exclusive)
          and isodow(d.trade_date) < 6
        left join bars b on b.exchange = l.exchange and b.code = l.code and b.trade_date = d.trade_date
        window w as (partition by l.exchange, l.code order by d.trade_date rows between unbounded preceding and 1 preceding)""",
    "action_ledger": f"""select {sql_venue('k')} as exchange, {sql_code6('k')} as code, k, ex_date,
        concat_ws('+', case when c > 0 then 'CASH_DIVIDEND' end, case when s = 1 then 'CAPITAL_TRANSFER' end,
          case when r = 1 then 'RIGHTS_ISSUE' end) as action_type,
        cast(c as decimal(18,2)) / 100 as cash, case when s = 1 then 0.5 else 0.0 end as transfer,
        case when r = 1 then 0.3 else 0.0 end as rights, case when r = 1 then 5.0 else 0.0 end as rights_price, n as source_count
        from (select cast(floor(o_custkey / 15) as bigint) as k, cast(o_orderdate as date) as ex_date,
          sum(o_orderkey % 50) as c, max(case when o_orderkey % 7 = 0 then 1 else 0 end) as s,
          max(case when o_orderkey % 13 = 0 then 1 else 0 end) as r, count(*) as n
          from orders group by 1, 2)""",
    "action_prior": """select a.*, b.trade_date as prior_trade_date, b.close as prior_close
        from action_ledger a asof left join bars b
        on a.exchange = b.exchange and a.code = b.code and a.ex_date > b.trade_date""",
    "components": f"""select {sql_venue('k')} as exchange, {sql_code6('k')} as code, ex_date, record_date, announcement_date,
        case kind when 'rights' then 'RIGHTS' else 'DIVIDEND_BONUS_TRANSFER' end as action_component,
        case kind when 'cash' then amount else 0 end as cash, case kind when 'bonus' then amount else 0 end as bonus,
        case kind when 'transfer' then amount else 0 end as transfer, case kind when 'rights' then amount else 0 end as rights,
        case kind when 'rights' then cast(5 + o_orderkey % 7 as decimal(18,6)) else 0 end as rights_price,
        case kind when 'rights' then ex_date + 20 end as rights_listing_date, o_orderkey, copy, o_orderpriority
        from (select *, cast(floor(o_custkey / 15) as bigint) as k, cast(o_orderdate as date) as ex_date,
          cast(o_orderdate as date) - cast(o_orderkey % 3 + 1 as integer) as record_date,
          cast(o_orderdate as date) - 30 as announcement_date, {_KIND_SQL} as kind,
          cast(cast(1 + o_orderkey % 50 as decimal(12,2)) / 100 as decimal(18,6)) as amount,
          unnest(case when o_orderstatus = 'P' then [1, 2] else [1] end) as copy
          from orders where not (o_orderstatus = 'F' and o_orderpriority = '2-HIGH'))""",
    "control_components": f"""select {sql_venue('k')} as exchange, {sql_code6('k')} as code, ex_date, record_date,
        case kind when 'cash' then 'DIVIDEND' when 'rights' then 'RIGHTS' else 'BONUS' end as action_component,
        case kind when 'cash' then amount else 0 end as cash, case kind when 'bonus' then amount else 0 end as bonus,
        case kind when 'transfer' then amount else 0 end as transfer, case kind when 'rights' then amount else 0 end as rights,
        case kind when 'rights' then cast(5 + o_orderkey % 7 as decimal(18,6)) else 0 end as rights_price, o_orderkey, shift
        from (select *, cast(cast(1 + o_orderkey % 50 as decimal(12,2)) / 100 + cast(shift as decimal(12,2)) as decimal(18,6)) as amount
          from (select *, cast(floor(o_custkey / 15) as bigint) as k, cast(o_orderdate as date) as ex_date,
            cast(o_orderdate as date) - cast(o_orderkey % 3 + 1 as integer) as record_date, {_KIND_SQL} as kind,
            unnest(case when o_orderkey % 17 = 0 then [case when o_orderkey % 11 = 0 then '0.01' else '0' end, '0.20']
              else [case when o_orderkey % 11 = 0 then '0.01' else '0' end] end) as shift
            from orders where o_orderstatus <> 'P'))""",
    "numbered_ledger": """select exchange, code, k, ex_date, action_type,
        cast(row_number() over (partition by exchange, code order by ex_date) as double) as rn from action_ledger""",
    "official_chain": """select exchange, code, ex_date, action_type,
        case when cast(rn as bigint) % 17 = 0
          then (1e0 + 0.05e0 * rn) / (1e0 + 0.05e0 * (rn - 1)) * 1.02e0
          when cast(rn as bigint) % 19 = 0 then 1.0004e0
          else (1e0 + 0.05e0 * rn) / (1e0 + 0.05e0 * (rn - 1)) end as theory from numbered_ledger""",
    "factors": """select exchange, code, ex_date + cast(k % 5 as integer) as effective_date,
        case when cast(rn as bigint) % 9 = 0 then (1e0 + 0.05e0 * rn) * 3 else 1e0 + 0.05e0 * rn end as fore,
        case when cast(rn as bigint) % 23 = 0 then 0e0 else 1e0 + 0.05e0 * rn end as back,
        1e0 + 0.05e0 * rn as adj
        from numbered_ledger where cast(rn as bigint) % 7 <> 0""",
}


def with_ctes(body: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """``body`` with the tables of ``CTES`` it needs (directly or through others) in front."""
    import re

    defined = dict(extra)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and name not in defined and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    for _, text in extra:
        visit(text)
    parts = [f"{n} as materialized ({CTES[n]})" for n in needed]
    # Materialized as well, unless it reads itself: a plan under a limit must not run a table anew for every row.
    for n, t in extra:
        itself = re.search(rf"\b(from|join)\s+{n}\b", t)
        parts.append(f"{n} as ({t})" if itself else f"{n} as materialized ({t})")
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
