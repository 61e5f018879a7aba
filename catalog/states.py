"""Daily state: indexes, limit rules, delisting periods, reclassification."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.bindings import RULES, with_ctes
from catalog.registry import plain, query
from pitgate.operators import state as st
from pitgate.operators.blocks import last_before, running_total
from pitgate.operators.joins import missing_keys
from pitgate.schema import SECURITY
from pitgate.sources.writers import stored

DAY = [*SECURITY, "trade_date"]

# Periods of final trading before a delisting, on any state rows `{src}`.
_PERIODS = """select exchange, code, arg_min(trade_date, i) as first_date, arg_min(last_day, i) as last_date,
    arg_min(left_n, i) as trade_days,
    case when arg_min(trade_date, i) < date '1999-11-15' or arg_min(left_n, i) > 15 then 'OLD_30DAY_ALL_10PCT' else 'NEW_15DAY_FIRST_NO_LIMIT' end as regime
  from (select *, max(case when tradable then i end) over (partition by exchange, code) as last_i,
      max(case when tradable then trade_date end) over (partition by exchange, code) as last_day,
      count(*) over (partition by exchange, code order by i rows between 10 preceding and 1 preceding) as prior_n,
      count(*) filter (where not tradable) over (partition by exchange, code order by i rows between 10 preceding and 1 preceding) as susp,
      count(*) filter (where tradable) over (partition by exchange, code order by i rows between current row and unbounded following) as left_n
    from (select *, row_number() over (partition by exchange, code order by trade_date) as i from {src}
      where date_diff('day', trade_date, listed_to_exclusive) between 1 and 120))
  where tradable and i >= last_i - 55 and prior_n >= 5 and susp >= 5 and left_n <= 30 group by exchange, code"""
_P = ("periods", _PERIODS.format(src="state"))


@query("carried_close", "W7", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date, cast(tradable as integer) as tradable,
  cast(preclose as double) as preclose from state"""))
def carried_close(spark, sf):
    rows = b.state_days(spark, sf)
    known = last_before(rows, SECURITY, "trade_date", F.col("close"), "preclose", block=None)
    return plain(known.select(*DAY, F.col("close").isNotNull().alias("tradable"), "preclose"))


@query("trading_index", "W1", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date,
  cast(sum(tradable::integer) over (partition by exchange, code order by trade_date) as bigint) as trade_index from state"""))
def trading_index(spark, sf):
    return plain(st.trading_index(b.state(spark, sf), block=None).select(*DAY, "trade_index"))


@query("remaining_tradable_days", "W3 W4", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date, cast(sum(tradable::integer) over (partition by exchange, code
  order by trade_date desc) as bigint) as remaining from state"""))
def remaining_tradable_days(spark, sf):
    counted = running_total(b.state(spark, sf), SECURITY, "trade_date", F.col("tradable").cast("int"),
                            "remaining", reverse=True, block=None)
    return plain(counted.select(*DAY, "remaining"))


@query("delisting_periods", "C8 W2 W3 W4", with_ctes("""
select exchange, code, cast(first_date as varchar) as first_date, cast(last_date as varchar) as last_date, trade_days, regime
from periods""", _P))
def delisting_periods(spark, sf):
    return plain(st.delisting_periods(b.state(spark, sf), b.intervals(spark, sf), RULES))


_INDEXED = ("indexed", """select s.*, sum(tradable::integer) over (partition by exchange, code order by trade_date) as ti,
  (exchange, code) in (select exchange, new_code from transitions) as successor from state s""")


# What each rule allows, and why; the tag of a delisting period says where it comes from.
_RATES = """case {rule} when 'RISK_WARNING_5PCT' then 0.05 when 'IPO_FIRST_DAY_2014_RULE' then {first} when 'DELISTING_CONSOLIDATION_10PCT' then 0.1
  when 'RISK_WARNING_10PCT' then 0.1 when 'MAIN_BOARD_10PCT' then 0.1 end::double"""
_UP, _DOWN = (lambda rule: _RATES.format(rule=rule, first=0.44)), (lambda rule: _RATES.format(rule=rule, first=0.36))
_PERIOD_EVIDENCE = """when 'DELISTING_15DAY_FIRST_DAY_NO_LIMIT' then 'BAOSTOCK_POINT_IN_TIME+EXCHANGE_2020_DELISTING_REFORM+{tag}'
  when 'DELISTING_CONSOLIDATION_10PCT' then 'BAOSTOCK_POINT_IN_TIME+EXCHANGE_DELISTING_RULE+{tag}'"""


@query("limit_rules", "C6 W1", with_ctes(f"""
select *, {_UP('limit_rule')} as limit_up_rate, {_DOWN('limit_rule')} as limit_down_rate,
  case limit_rule when 'SUSPENDED' then 'BAOSTOCK_POINT_IN_TIME' {_PERIOD_EVIDENCE.format(tag='FINAL_TRADING_BLOCK')}
    when 'IPO_FIRST5_NO_LIMIT' then 'LIFECYCLE+EXCHANGE_REGISTRATION_RULE' when 'IPO_FIRST_DAY_2014_RULE' then 'LIFECYCLE+EXCHANGE_IPO_RULE'
    when 'MAIN_BOARD_10PCT' then 'EXCHANGE_RULE_VERSION' else 'BAOSTOCK_POINT_IN_TIME+EXCHANGE_RULE_VERSION' end as evidence
from (select i.exchange, i.code, cast(i.trade_date as varchar) as trade_date, case
  when not tradable then 'SUSPENDED'
  when p.regime = 'NEW_15DAY_FIRST_NO_LIMIT' and i.trade_date = p.first_date then 'DELISTING_15DAY_FIRST_DAY_NO_LIMIT'
  when i.trade_date between p.first_date and p.last_date then 'DELISTING_CONSOLIDATION_10PCT'
  when not successor and listed_from >= date '1995-07-01' and ti <= 5 then 'IPO_FIRST5_NO_LIMIT'
  when not successor and listed_from between date '1995-02-01' and date '1995-06-30' and ti = 1 then 'IPO_FIRST_DAY_2014_RULE'
  when risk_warning and i.trade_date < date '1998-01-01' then 'RISK_WARNING_5PCT'
  when risk_warning then 'RISK_WARNING_10PCT' else 'MAIN_BOARD_10PCT' end as limit_rule
from indexed i left join periods p using (exchange, code))""", _P, _INDEXED))
def limit_rules(spark, sf):
    lives = stored(b.life(spark, sf), "life")
    successors = b.transitions_of(lives).select("exchange", F.col("new_code").alias("code"))
    ruled = st.classify_state(b.state(spark, sf, lives), lives.drop("k"), RULES, successors=successors)
    return plain(ruled.select(*DAY, "limit_rule", "limit_up_rate", "limit_down_rate", "evidence"))


@query("limit_rules_v1", "C6b", with_ctes("""
select exchange, code, cast(trade_date as varchar) as trade_date, rule as limit_rule,
  UP as limit_up_rate, DOWN as limit_down_rate from (select *, case when not tradable then 'SUSPENDED'
  when listed_from >= date '1995-07-01' and ti <= 5 then 'IPO_FIRST5_NO_LIMIT'
  when listed_from between date '1995-01-01' and date '1995-06-30' and ti = 1 then 'IPO_FIRST_DAY_2014_RULE'
  when abs(coalesce(pct_chg, 0)) > 10.5 and date_diff('day', trade_date, listed_to_exclusive) between 1 and 45 then 'DELISTING_OR_TERMINATION_SPECIAL_NO_LIMIT'
  when abs(coalesce(pct_chg, 0)) > 10.5 then 'UNCLASSIFIED_SPECIAL_NO_LIMIT'
  when risk_warning and trade_date < date '1998-01-01' then 'RISK_WARNING_5PCT'
  when risk_warning then 'RISK_WARNING_10PCT' else 'MAIN_BOARD_10PCT' end as rule from indexed)""".replace("UP", _UP("rule")).replace("DOWN", _DOWN("rule")), _INDEXED))
def limit_rules_v1(spark, sf):
    ruled = st.classify_state(b.state(spark, sf), b.intervals(spark, sf), RULES, mode="v1", legacy=True)
    return plain(ruled.select(*DAY, "limit_rule", "limit_up_rate", "limit_down_rate"))


@query("unexplained_moves", "C7", with_ctes("""
select i.exchange, i.code, cast(i.trade_date as varchar) as trade_date, round(pct_chg, 4) as pct_chg
from indexed i left join periods p using (exchange, code)
where tradable and abs(coalesce(pct_chg, 0)) > 10.5
  and not coalesce(p.regime = 'NEW_15DAY_FIRST_NO_LIMIT' and i.trade_date = p.first_date, false)
  and not (not coalesce(i.trade_date between p.first_date and p.last_date, false) and not successor
    and (listed_from >= date '1995-07-01' and ti <= 5 or listed_from between date '1995-02-01' and date '1995-06-30' and ti = 1))""",
                                        _P, _INDEXED))
def unexplained_moves(spark, sf):
    lives = stored(b.life(spark, sf), "life")
    successors = b.transitions_of(lives).select("exchange", F.col("new_code").alias("code"))
    ruled = st.classify_state(b.state(spark, sf, lives), lives.drop("k"), RULES, successors=successors)
    return plain(st.unexplained_moves(ruled).select(*DAY, F.round("pct_chg", 4).alias("pct_chg")))


def _ruled(spark, sf, lives=None):
    """State as an earlier run would have ruled it: by today's code, with the v1 rules."""
    lives = b.life(spark, sf) if lives is None else lives
    return st.classify_state(b.state(spark, sf, lives), lives.drop("k"), RULES, mode="v1", legacy=True)


def _reclassified(spark, sf):
    life = stored(b.life(spark, sf), "life")
    changes = b.transitions_of(life)
    quiet = life.where("k % 6 = 5").select(
        *SECURITY, F.lit("1996-05-13").cast("date").alias("trade_date"), F.lit("SCHEDULE").alias("reason"))
    relisted = life.where("k % 6 = 4").select(*SECURITY, F.lit("2000-02-01").cast("date").alias("trade_date"))
    closed = life.where("listed_to_exclusive is not null").select(*SECURITY, "listed_to_exclusive")
    return st.reclassify(_ruled(spark, sf, life), closed, changes, quiet, relisted, RULES)


_RULED = ("ruled", """select *, case when not tradable then 'SUSPENDED'
  when listed_from >= date '1995-07-01' and ti <= 5 then 'IPO_FIRST5_NO_LIMIT'
  when listed_from between date '1995-01-01' and date '1995-06-30' and ti = 1 then 'IPO_FIRST_DAY_2014_RULE'
  when abs(coalesce(pct_chg, 0)) > 10.5 and date_diff('day', trade_date, listed_to_exclusive) between 1 and 45 then 'DELISTING_OR_TERMINATION_SPECIAL_NO_LIMIT'
  when abs(coalesce(pct_chg, 0)) > 10.5 then 'UNCLASSIFIED_SPECIAL_NO_LIMIT'
  when risk_warning and trade_date < date '1998-01-01' then 'RISK_WARNING_5PCT'
  when risk_warning then 'RISK_WARNING_10PCT' else 'MAIN_BOARD_10PCT' end as rule from indexed""")
_QUIET = ("quiet", """select r.exchange, coalesce(t.old_code, r.code) as code, r.k, r.trade_date, r.listed_to_exclusive,
  case when q then false else tradable end as tradable, case when q then 'SUSPENDED' else rule end as rule,
  t.old_code is not null as remapped, q as quieted, q and (tradable or rule <> 'SUSPENDED') as overridden
  from (select *, k % 6 = 5 and trade_date = date '1996-05-13' and (exchange, code) not in (select exchange, new_code from transitions where effective_date > date '1996-05-13') as q from ruled) r
  left join transitions t on t.exchange = r.exchange and t.new_code = r.code and r.trade_date < t.effective_date""")
_TARGET = ("target", """select q.*, case
    when q.k % 6 = 4 and q.trade_date = date '2000-02-01' and not q.remapped then 'RELISTING_FIRST_DAY_NO_LIMIT'
    when tradable and p.regime = 'NEW_15DAY_FIRST_NO_LIMIT' and q.trade_date = p.first_date then 'DELISTING_15DAY_FIRST_DAY_NO_LIMIT'
    when tradable and q.trade_date between p.first_date and p.last_date then 'DELISTING_CONSOLIDATION_10PCT' end as target
  from quiet q left join periods p using (exchange, code)""")
_QP = ("periods", _PERIODS.format(src="quiet"))


@query("state_reclassified", "C9 J14 N23", with_ctes(f"""
select exchange, code, cast(trade_date as varchar) as trade_date, cast(tradable as integer) as tradable,
  coalesce(target, rule) as limit_rule, cast(remapped as integer) as remapped, cast(overridden as integer) as overridden,
  cast(coalesce(target <> rule, false) as integer) as rewritten,
  {_UP('coalesce(target, rule)')} as limit_up_rate, {_DOWN('coalesce(target, rule)')} as limit_down_rate,
  case target when 'RELISTING_FIRST_DAY_NO_LIMIT' then 'EXCHANGE_OFFICIAL_RELISTING_ANNOUNCEMENT+OFFLINE_OVERRIDE' {_PERIOD_EVIDENCE.format(tag='OFFLINE_FINAL_BLOCK_RECLASS')}
    else case when quieted then 'SCHEDULE+OFFLINE_OVERRIDE' else 'BAOSTOCK_POINT_IN_TIME+EXCHANGE_RULE_VERSION' ||
      case when remapped then '+OFFICIAL_CODE_TIME_IDENTITY_REMAP' else '' end end end as evidence from target""", _INDEXED, _RULED, _QUIET, _QP, _TARGET))
def state_reclassified(spark, sf):
    out, _, _ = _reclassified(spark, sf)
    return plain(out.select(*DAY, "tradable", "limit_rule", "remapped", "overridden", "rewritten",
                            "limit_up_rate", "limit_down_rate", "evidence"))


@query("reclassification_counts", "A2 A15 C9", with_ctes("""
select count(*) as n_rows, count_if(tradable) as tradable, count_if(not tradable) as suspended, count_if(remapped) as remapped,
  count_if(overridden) as overridden, count_if(coalesce(target <> rule, false)) as rewritten,
  count_if(coalesce(target, rule) = 'UNCLASSIFIED_SPECIAL_NO_LIMIT') as remaining from target""", _INDEXED, _RULED, _QUIET, _QP, _TARGET))
def reclassification_counts(spark, sf):
    out, _, _ = _reclassified(spark, sf)
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("tradable").alias("tradable"),
        F.count_if(~F.col("tradable")).alias("suspended"), F.count_if("remapped").alias("remapped"),
        F.count_if("overridden").alias("overridden"), F.count_if("rewritten").alias("rewritten"),
        F.count_if(F.col("limit_rule") == "UNCLASSIFIED_SPECIAL_NO_LIMIT").alias("remaining"))


@query("relisting_faults", "J14", with_ctes("""
select 'relisting day without exactly one state row' as "check", exchange || ':' || code || ':2000-02-01' as key, '0' as detail
from life l where k % 6 = 4 and not exists (select 1 from quiet q where q.exchange = l.exchange and q.code = l.code
  and q.trade_date = date '2000-02-01')""", _INDEXED, _RULED, _QUIET))
def relisting_faults(spark, sf):
    _, _, bad = _reclassified(spark, sf)
    return bad


@query("identity_manifest", "A15 A4", with_ctes("""
select exchange, code, count(*) as "rows", cast(min(trade_date) as varchar) as first, cast(max(trade_date) as varchar) as last
from state group by 1, 2"""))
def identity_manifest(spark, sf):
    return plain(st.identity_manifest(b.state(spark, sf)))


@query("suspended_days_without_bar", "J5 J3", with_ctes("""
select s.exchange, s.code, count(*) as days from state s where not s.tradable
and not exists (select 1 from bars b where b.exchange = s.exchange and b.code = s.code and b.trade_date = s.trade_date)
group by 1, 2"""))
def suspended_days_without_bar(spark, sf):
    quiet = missing_keys(b.state(spark, sf).where("not tradable"), b.bars(spark, sf), DAY)
    return quiet.groupBy(*SECURITY).agg(F.count(F.lit(1)).alias("days"))
