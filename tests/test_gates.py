import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgate import schema
from pitgate.operators import aggregates as ag
from pitgate.operators import checks as ck
from pitgate.plans import facts as fx
from pitgate.plans import gates as gt
from pitgate.schema import Rules
from tests.helpers import checks, day, dec, names, rows

RULES = Rules(coverage_start=dt.date(2015, 1, 5), coverage_end=dt.date(2015, 1, 9))
DAYS = ["2015-01-05", "2015-01-06", "2015-01-07", "2015-01-08", "2015-01-09"]


def test_master_gate(spark):
    ddl = "exchange string, code string, board string, security_type string, board_basis string"
    good = spark.createDataFrame([("SSE", "600000", "MAIN", "A_SHARE", "X"), ("SZSE", "000001", "MAIN", "A_SHARE", "X")], ddl)
    assert checks(gt.master_gate(good, good, {"SSE": 1, "SZSE": 1})) == []
    bad = spark.createDataFrame([("SSE", "688001", "GEM", "A_SHARE", "DERIVED_CODE_PREFIX"), ("SSE", "688001", "MAIN", "A_SHARE", "X"),
                                 ("SZSE", "300001", "MAIN", "A_SHARE", "X"), ("NYSE", "1", "MAIN", "A_SHARE", "X")], ddl)
    assert names(gt.master_gate(bad, good, {"SSE": 3})) == sorted(["growth-board code of the second venue", "technology-board code of the first venue", "duplicate security", "fewer securities than plausible", "invalid exchange",
        "only in control", "only in primary", "out-of-scope row", "board only guessed from the code"])
    long = good.union(spark.createDataFrame([("SSE", "693007", "MAIN", "A_SHARE", "X"), ("SZSE", "303008", "MAIN", "A_SHARE", "X")], ddl))
    listed = long.withColumn("listed", F.replace(F.replace("code", F.lit("693"), F.lit("688")), F.lit("303"), F.lit("301")))
    assert checks(gt.master_gate(listed, long, {"SSE": 1}, "listed")) == [
        ("growth-board code of the second venue", "SZSE:303008"), ("technology-board code of the first venue", "SSE:693007")]


def test_clean_lifecycle_passes(spark):
    intervals = spark.createDataFrame([
        ("SSE", "601313", "o", day("2012-01-16"), day("2018-02-28"), "R", "P"), ("SSE", "601360", "n", day("2018-02-28"), None, "P", None),
        ("SSE", "600001", "x", day("2000-01-01"), day("2016-01-01"), "R", "R"), ("SZSE", "000004", "y", day("1990-12-01"), day("2026-07-14"), "R", "R")], schema.INTERVAL)
    master = spark.createDataFrame([("SSE", "601360")], "exchange string, code string")
    events = spark.createDataFrame([("SSE", "601360", "LIST", day("2012-01-16")), ("SSE", "600001", "LIST", day("2000-01-01")),
                                    ("SSE", "600001", "DELIST", day("2016-01-01")), ("SZSE", "000004", "LIST", day("1990-12-01")),
                                    ("SZSE", "000004", "DELIST", day("2026-07-14"))],
                                   "exchange string, code string, event_type string, effective_date date")
    change = spark.createDataFrame([("SSE", "601313", "601360", day("2018-02-28"), "P")],
                                   "exchange string, old_code string, new_code string, effective_date date, evidence_class string")
    counts = lambda *n: spark.createDataFrame(list(zip(
        ("current_active", "delisted_a_all_history", "expected_intervals", "lifecycle_events", "code_transitions"), map(str, n))),
        "name string, expected string")
    assert checks(gt.lifecycle_gate(master, intervals, events, change, counts(1, 2, 4, 5, 1), Rules())) == []
    late = change.withColumn("effective_date", F.lit("2018-03-01").cast("date")).withColumn("evidence_class", F.lit("Q"))
    assert names(gt.lifecycle_gate(master, intervals, events, late, counts(1, 2, 4, 5, 2), Rules())) == sorted(["manifest count mismatch", "predecessor ends on another day", "end of predecessor has other evidence",
        "start of successor has other evidence", "successor starts on another day"])


def stored_bars(spark):
    data = [(e, c, day(d), *[dec(10)] * 4, 1, 1, 2015) for e, c in [("SSE", "600000"), ("SZSE", "000001")] for d in DAYS]
    return spark.createDataFrame(data, T.StructType([*schema.BAR.fields, T.StructField("year", T.IntegerType())]))


def bars_inputs(spark):
    bars = stored_bars(spark)
    life = spark.createDataFrame([("SSE", "600000", day("1999-11-10"), None), ("SZSE", "000001", day("1991-04-03"), None)],
                                 "exchange string, code string, listed_from date, listed_to_exclusive date")
    sources = spark.createDataFrame([(0, 1, "SSE", "600000", "a" * 64, 9, 5)],
                                    "shard int, shards int, exchange string, code string, sha256 string, bytes int, normalized_rows bigint")
    days = spark.createDataFrame([("SZSE", day(d), "b" * 64, 9, 1, 1) for d in DAYS],
                                 "exchange string, day date, sha256 string, bytes int, source_rows bigint, normalized_rows bigint")
    from catalog.aggregates import partition_digests

    files = partition_digests(bars, "year").select("exchange", "year", F.col("n").alias("rows"), F.col("digest").alias("sha256"))
    return bars, life, sources, days, files


def test_clean_bars_pass(spark):
    bars, life, sources, days, files = bars_inputs(spark)
    found, quiet = gt.bars_gate(bars, life, sources, days, files, RULES)
    assert checks(found) == [] and checks(quiet) == []


def test_each_bar_fault_is_found(spark):
    bars, life, sources, days, files = bars_inputs(spark)
    twice = bars.unionByName(bars.limit(1))
    assert {"duplicate key", "row-count mismatch", "data sha mismatch", "row accounting mismatch"} <= set(
        names(gt.bars_gate(twice, life, sources, days, files, RULES)[0]))
    gap = bars.where("not (exchange = 'SZSE' and trade_date = date '2015-01-06')")
    assert {"positive source day without data", "trading-day calendar mismatch"} <= set(
        names(gt.bars_gate(gap, life, sources, days, files, RULES)[0]))
    assert "weekday not requested" in names(gt.bars_gate(bars, life, sources, days.limit(4), files, RULES)[0])
    lost = sources.withColumn("shards", F.lit(2))
    assert names(gt.bars_gate(bars, life, lost, days, files, RULES)[0]) == sorted(["missing shards"])
    silent = sources.withColumn("normalized_rows", F.lit(0).cast("bigint"))
    found, quiet = gt.bars_gate(bars.where("exchange = 'SZSE'"), life, silent, days, files.where("exchange = 'SZSE'"), RULES)
    assert len(checks(quiet)) == 1 and "trading-day calendar mismatch" in names(found)


def test_period_rules(spark):
    ddl = "exchange string, code string, first_date date, last_date date, trade_days int, regime string"
    make = lambda first, n, regime: spark.createDataFrame([("SSE", "1", day(first), day(first), n, regime)], ddl)
    assert checks(gt.period_violations(make("2021-03-01", 15, "NEW_15DAY_FIRST_NO_LIMIT"), Rules())) == []
    assert checks(gt.period_violations(make("2021-03-01", 16, "OLD_30DAY_ALL_10PCT"), Rules())) == []
    assert names(gt.period_violations(make("2021-03-01", 9, "OLD_30DAY_ALL_10PCT"), Rules())) == sorted(["short period after the reform under the old regime"])
    assert names(gt.period_violations(make("2019-03-01", 16, "NEW_15DAY_FIRST_NO_LIMIT"), Rules())) == sorted(["new delisting period too long", "period before the reform under the new regime"])
    assert names(gt.period_violations(make("2019-03-01", 31, "OTHER"), Rules())) == sorted(["unknown delisting regime"])


def test_stage_gate(spark):
    reports = spark.createDataFrame([("G1", True), ("G2", False), ("G3", True)], "gate string, pass boolean")
    config = spark.createDataFrame([("G1", "PASS"), ("G2", "PASS"), ("G3", "FAIL"), ("G4", "PASS")], "gate string, status string")
    assert checks(gt.stage_gate(reports, config)) == [
        ("evidence passes but config does not", "G3"), ("gate evidence does not pass", "G2"), ("gate evidence missing", "G4")]


def test_facts(spark):
    facts = fx.facts_of(spark.createDataFrame([(5, "x", [1])], "n int, s string, a array<int>"), "g.")
    assert rows(facts) == [("g.n", "5"), ("g.s", "x")]
    pins = spark.createDataFrame([("g.n", "5"), ("g.s", "y"), ("g.t", "1")], "name string, expected string")
    assert checks(fx.unmet_pins(facts, pins)) == [("pinned figure not met", "g.s"), ("pinned figure not met", "g.t")]
    pairs = spark.createDataFrame([("c", "g.n", "g.n"), ("c", "g.n", "g.s"), ("c", "g.n", "g.q")], "check string, left string, right string")
    assert checks(fx.unequal_pairs(facts, pairs)) == [("c", "g.n=g.q"), ("c", "g.n=g.s")]
    floors = spark.createDataFrame([("g.n", 5), ("g.s", 1)], "name string, floor bigint")
    assert checks(fx.below_floor(facts, floors)) == [("implausibly small figure", "g.s")]
    same = fx.canonical_fingerprint(facts.repartition(3)).first()[0]
    assert same == fx.canonical_fingerprint(facts.orderBy(F.desc("name"))).first()[0]


def test_content_digest_ignores_order_and_partitioning(spark):
    lines = spark.range(1000).select(F.concat(F.lit("line "), "id").alias("l"))
    digest = lambda df: df.agg(ag.content_digest(F.col("l"))).first()[0]
    want = digest(lines)
    assert digest(lines.repartition(7)) == want == digest(lines.orderBy(F.desc("l")))
    assert digest(lines.where("l <> 'line 5'")) != want
    assert digest(lines.unionByName(lines.limit(1))) != want


def test_unique_rows_and_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    clean, bad = ck.enforce_unique(df, ["k"])
    assert rows(clean) == [("b", 3)] and checks(bad) == [("duplicate key", "a")]
    made = ck.report("G9", bad, df.agg(F.count(F.lit(1)).alias("rows"))).first()
    assert (made["gate"], made["pass"], made["rows"], made["n_errors"], made["errors"]) == ("G9", False, 3, 1, ["duplicate key: a 2"])
    none = ck.report("G9", bad.limit(0), df.agg(F.count(F.lit(1)).alias("rows")), warnings=bad).first()
    assert (none["pass"], none["errors"], none["warnings"]) == (True, [], ["duplicate key: a 2"])
    many = spark.range(100).select(F.lit("c").alias("check"), F.lpad(F.col("id").cast("string"), 3, "0").alias("key"), F.lit("").alias("detail"))
    assert ck.samples(many, 20).count() == 20 and ck.summarize(many).first()["last_key"] == "099"


def final_facts(spark, **changed):
    facts = {name: expected for _, name, expected in gt.FINAL_PINS} | {n: "f" for n in gt.FINAL_PRINTS}
    facts |= {n: "7" for _, *both in gt.FINAL_PAIRS for n in both} | changed
    return spark.createDataFrame([(k, v) for k, v in facts.items() if v is not None], "name string, value string")


def test_final_gate(spark):
    assert checks(gt.final_gate(final_facts(spark))) == []
    for check, name, _ in gt.FINAL_PINS:
        assert checks(gt.final_gate(final_facts(spark, **{name: "1"}))) == [(check, name)]
    for check, left, right in gt.FINAL_PAIRS:
        assert (check, f"{left}={right}") in checks(gt.final_gate(final_facts(spark, **{right: "8"})))
    missing = gt.final_gate(final_facts(spark, **{"chain.fingerprint": "", "bars.fingerprint": None}))
    assert checks(missing) == [("fingerprint missing", "bars.fingerprint"), ("fingerprint missing", "chain.fingerprint")]
    prints = {gt.final_fingerprint(final_facts(spark, **c)).first()[0] for c in ({}, {"control.mismatches": "1"}, {"chain.fingerprint": "g"})}
    assert len(prints) == 3


def test_freeze_gate(spark):
    frame = spark.createDataFrame
    named = lambda pairs: frame(pairs, "name string, value string")
    basis = [("basis.G3.fingerprint", "p"), ("basis.G3.rows", "9")]
    print_ = fx.canonical_fingerprint(named(basis)).first()[0]
    gates = lambda ok=True, n=0, p="p": frame([("G3", ok, n, p)], "gate string, pass boolean, errors int, fingerprint string")
    digests = lambda *pairs: frame(pairs, "key string, sha256 string")
    pins = frame([("not enabled", "status", "PASS")], "check string, name string, expected string")
    pairs = frame([("rows differ", "basis.G3.rows", "g3.rows")], "check string, left string, right string")

    def found(manifest=(("status", "PASS"), ("fingerprint", print_)), rows_="9", evidence=None,
              sums=(("a", "x"), ("canonical", print_)), files=(("a", "x"),)):
        return checks(gt.freeze_gate(named([*basis, *manifest]), named([("g3.rows", rows_)]), evidence or gates(),
                                     digests(*sums), digests(*files), pins, pairs))

    assert found() == []
    assert found(rows_="8") == [("rows differ", "basis.G3.rows=g3.rows")]
    assert found(manifest=(("status", "FAIL"), ("fingerprint", print_))) == [("not enabled", "status")]
    assert found(manifest=(("status", "PASS"), ("fingerprint", "old"))) == [("canonical fingerprint differs", "fingerprint")]
    assert found(evidence=gates(False)) == [("gate does not pass", "G3")]
    assert found(evidence=gates(n=2)) == [("gate reports errors", "G3")]
    assert found(evidence=gates(p="q")) == [("gate fingerprint differs from the manifest", "G3")]
    assert found(files=(("a", "y"),)) == [("evidence digest mismatch", "a")]
    assert found(files=()) == [("evidence missing", "a")]
    assert found(files=(("a", "x"), ("b", "z"))) == [("file without registered digest", "b")]
    assert found(sums=(("a", "x"), ("canonical", "old"))) == [("evidence digest mismatch", "canonical")]


def test_a_period_must_open_with_its_own_rule(spark):
    shape = ("exchange string, code string, trade_date date, tradable boolean, limit_rule string, limit_up_rate decimal(4,2), "
             "limit_down_rate decimal(4,2)")
    days = [dt.date(2022, 3, 1), dt.date(2022, 3, 2)]
    state = lambda first: spark.createDataFrame(
        [("SSE", "1", d, True, r, None, None) for d, r in zip(days, (first, "DELISTING_CONSOLIDATION_10PCT"), strict=True) if r], shape)
    periods = spark.createDataFrame([("SSE", "1", days[0], days[1], 2, "NEW_15DAY_FIRST_NO_LIMIT")],
                                    "exchange string, code string, first_date date, last_date date, trade_days int, regime string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    key = none("exchange string, code string, trade_date date")
    changes = none("exchange string, old_code string, new_code string, effective_date date")

    def found(first):
        rows_ = state(first)
        universe = rows_.select("exchange", "code").distinct()
        manifest = rows_.groupBy("exchange", "code").agg(F.count("*").alias("rows")).withColumn("sha256", F.lit("x"))
        bars = rows_.select("exchange", "code", "trade_date").withColumn("close", F.lit(1))
        return names(gt.state_gate(rows_, universe, manifest, periods, key, changes, bars, key, Rules()))

    assert found("DELISTING_15DAY_FIRST_DAY_NO_LIMIT") == []
    assert found("MAIN_BOARD_10PCT") == ["delisting period opens under another rule"]
    assert found(None) == ["delisting period without one row on its first day"]
