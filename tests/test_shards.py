from pyspark.sql import functions as F

from pitgate.plans import shards as sh
from tests.helpers import checks, day, names

FILE, KEY = "file string, sha256 string", "exchange string, code string"
LANES = [sh.Lane("PRIMARY", 2), sh.Lane("RIGHTS", 1, venue="SZSE", optional=True), sh.Lane("CONTROL", 1, queried=False)]


def manifest(spark, *changes):
    base = {("PRIMARY", 0): ["p0", "a", 2, 3, []], ("PRIMARY", 1): ["p1", "b", 1, 1, []], ("CONTROL", 0): ["c", "c", 0, 0, None]}
    for shard, values in changes:
        base[shard] = values
    return spark.createDataFrame([(*k, *v) for k, v in base.items() if v], sh.MANIFEST)


def files(spark, **changed):
    return spark.createDataFrame([(k, v) for k, v in ({"p0": "a", "p1": "b", "c": "c"} | changed).items() if v], FILE)


def test_shards(spark):
    found = lambda m, f: checks(sh.shard_violations(m, f, LANES))
    assert found(manifest(spark), files(spark)) == []
    assert found(manifest(spark, (("PRIMARY", 0), None)), files(spark)) == [("file of no shard", "p0"), ("shards missing", "PRIMARY")]
    assert found(manifest(spark, (("PRIMARY", 2), ["p2", "d", 0, 0, []])), files(spark, p2="d")) == [("shards missing", "PRIMARY")]
    assert found(manifest(spark, (("RIGHTS", 1), ["r", "r", 0, 0, []])), files(spark, r="r")) == [("shards missing", "RIGHTS")]
    assert found(manifest(spark, (("OTHER", 0), ["o", "o", 0, 0, []])), files(spark, o="o")) == [("unknown lane", "OTHER")]
    assert found(manifest(spark), files(spark, p0="x")) == [("shard file digest differs", "PRIMARY:0:p0")]
    assert found(manifest(spark), files(spark, c=None)) == [("shard file missing", "CONTROL:0:c")]
    assert found(manifest(spark, (("PRIMARY", 0), ["p0", "a", 2, 3, ["timed out", "no page"]])), files(spark)) == [("source error", "PRIMARY:0")] * 2
    twice = manifest(spark).unionByName(manifest(spark).where("data_file = 'p1'").withColumn("data_file", F.lit("p0")).withColumn("data_sha256", F.lit("a")))
    assert found(twice, files(spark)) == [("shard listed twice", "PRIMARY:1")]
    none = spark.createDataFrame([], sh.MANIFEST)
    assert found(none, spark.createDataFrame([], FILE)) == [("shards missing", "CONTROL"), ("shards missing", "PRIMARY")]


def test_ledger_gate(spark):
    universe = spark.createDataFrame([("SSE", "1"), ("SSE", "2"), ("SZSE", "3")], KEY)
    act = "exchange string, code string, ex_date date"
    primary = spark.createDataFrame([("PRIMARY", 0)] * 3 + [("PRIMARY", 1)], "lane string, shard int")
    ledger = spark.createDataFrame([("SSE", "1", day("2020-05-06"), "CASH_DIVIDEND")], f"{act}, action_type string")
    control = spark.createDataFrame([("SSE", "1", day("2020-05-06"), "DIVIDEND"), ("SSE", "2", day("2020-05-07"), "RIGHTS")], f"{act}, action_component string")
    none = spark.createDataFrame([], "check string, key string, detail string")

    def found(m=None, rows_=primary, asked=universe, made=ledger, native=control, faults=none):
        return checks(sh.ledger_gate(m or manifest(spark), files(spark), rows_, native, asked, made, faults, LANES))

    assert found() == []
    assert found(rows_=primary.limit(0)) == [("declared and found counts differ", "PRIMARY:0"), ("declared and found counts differ", "PRIMARY:1")]
    assert found(asked=universe.where("code <> '3'")) == [("queried securities and universe differ", "PRIMARY")]
    late = control.where("action_component = 'DIVIDEND'").withColumn("ex_date", F.lit("2020-05-08").cast("date"))
    assert found(native=control.unionByName(late)) == [("native event missing from the ledger", "SSE:1:2020-05-08")]
    assert found(made=ledger.withColumn("action_type", F.lit(""))) == [("action without amounts", "SSE:1:2020-05-06")]
    assert found(made=ledger.unionByName(ledger)) == [("action listed twice", "SSE:1:2020-05-06")]
    assert found(faults=spark.createDataFrame([("x", "y", "")], none.schema)) == [("x", "y")]


def test_state_shards_gate(spark):
    state = spark.createDataFrame([("STATE", k % 2, "SSE", str(k), day(d), k != 2, False) for k in (0, 1, 2) for d in ("2020-01-02", "2020-01-03")],
                                  "lane string, shard int, exchange string, code string, trade_date date, tradable boolean, risk_warning boolean")
    by_shard, each = sh.state_counts_by_shard(state)
    stored = spark.createDataFrame([("p0", "a"), ("p1", "b")], FILE)
    manifests = by_shard.withColumns({"data_file": F.concat(F.lit("p"), F.col("shard").cast("string")), "errors": F.array().cast("array<string>"),
                                      "data_sha256": F.when(F.col("shard") == 0, "a").otherwise("b")})
    sources = each.select("lane", "shard", "exchange", "code", "rows").withColumn("sha256", F.lit("s"))
    universe = sources.select("exchange", "code")
    again = spark.createDataFrame([("SSE", "1", day("2020-01-03"))], "exchange string, code string, trade_date date")

    def found(m=manifests, f=stored, s=sources, rows_=state, u=universe, told=again, official=again):
        return checks(sh.state_shards_gate(m, f, s, rows_, u, told, official, shards=2))

    assert found() == []
    assert found(m=manifests.withColumn("suspended", F.col("suspended") + 1)) == [("declared and found counts differ", f"STATE:{i}") for i in (0, 1)]
    assert found(m=manifests.where("shard = 0"))[-2:] == [("queried securities and universe differ", "STATE"), ("shards missing", "STATE")]
    assert found(s=sources.withColumn("rows", F.col("rows") + (F.col("code") == "1").cast("int"))) == [("source rows differ from state rows", "SSE:1")]
    assert found(s=sources.withColumn("sha256", F.when(F.col("code") != "2", "s"))) == [("source hash missing", "SSE:2")]
    assert found(s=sources.where("code <> '0'")) == [("rows of no source", "SSE:0"), ("security of no source", "SSE:0")]
    moved = sources.unionByName(sources.where("code = '0'").withColumn("shard", F.lit(1)))
    assert found(s=moved) == [("security in several shards", "SSE:0"), ("source without rows", "SSE:0")]
    assert found(told=again.limit(0)) == [("relisting day that no manifest has", "SSE:1:2020-01-03")]
    assert found(official=again.limit(0)) == [("relisting day that is not on the list", "SSE:1:2020-01-03")]


def test_fingerprint_moves_with_files_and_rows(spark):
    rows_ = spark.range(100).withColumn("t", F.col("id").cast("string"))
    print_ = lambda f, r: sh.shards_fingerprint(f, F.col("t"), r).first()[0]
    one = print_(files(spark), rows_)
    assert one == print_(files(spark).repartition(3), rows_.orderBy(F.desc("id"))) and len(one) == 64
    assert len({one, print_(files(spark, c="x"), rows_), print_(files(spark), rows_.where("id > 0"))}) == 3
    assert names(sh.shard_violations(manifest(spark), files(spark), LANES)) == []
