import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgate import schema
from pitgate.sources import readers as rd
from pitgate.sources import writers as wr
from tests.helpers import checks, day, dec, rows


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def bars(spark, items):
    return spark.createDataFrame([("SSE", c, day(d), *[dec(p)] * 4, 1, 2) for c, d, p in items], schema.BAR)


BARS = [("600000", "2017-01-03", 1), ("600001", "2017-01-03", 2), ("600000", "2018-01-03", 3), ("600001", "2018-01-03", 4)]


def test_csv_round_trip_and_header_contract(spark, folder):
    df = bars(spark, BARS)
    wr.write_sorted_csv(df, folder, ["trade_date", "code"])
    back = rd.read_table(spark, folder, schema.BAR)
    assert rows(back) == rows(df)
    wrong = T.StructType([*schema.BAR.fields[:-1], T.StructField("other", T.LongType())])
    with pytest.raises(Exception, match="(?i)header|malformed"):
        rd.read_table(spark, folder, wrong).collect()


def test_years_are_pruned_and_rewritten_alone(spark, folder):
    wr.write_years(bars(spark, BARS), folder, "trade_date", ["trade_date", "code"])
    untouched = lambda: {f for f in spark.read.parquet(folder).inputFiles() if "year=2017" in f}
    before = untouched()
    wr.rewrite_years(bars(spark, [("600000", "2018-01-03", 9)]), folder, "trade_date", ["trade_date", "code"])
    after = spark.read.parquet(folder)
    assert rows(after.where("year = 2018"), "code", "close") == [("600000", dec(9))]
    assert before == untouched() != set()
    plan = after.where("year = 2017")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_payload_rows_take_the_first_filled_array(spark):
    docs = ['cb({"result":[{"A_STOCK_CODE":"600000","COMPANY_ABBR":"A"}]});', '{"result":[],"data":[{"A_STOCK_CODE":"600001"}]}',
            'x({"result":[]})', ' cb_1({"result":[{"A_STOCK_CODE":"600002","COMPANY_ABBR":"(b)"}]})\n']
    got = rd.payload_rows(spark.createDataFrame([(d,) for d in docs], "p string"), "p", ["A_STOCK_CODE", "COMPANY_ABBR"])
    assert rows(got, "A_STOCK_CODE", "COMPANY_ABBR") == [("600000", "A"), ("600001", None), ("600002", "(b)")]


def test_raw_files_and_json_arrays(spark, tmp_path):
    raw = tmp_path / "a.jsonp"
    raw.write_text('cb({"result":[{"A_STOCK_CODE":"600000"}]})', encoding="utf-8")
    got = rd.read_payloads(spark, str(raw)).first()
    assert got["sha256"] == hashlib.sha256(raw.read_bytes()).hexdigest()
    table = tmp_path / "changes.json"
    table.write_text(json.dumps([{"exchange": "SSE", "old_code": "601313", "new_code": "601360"}], indent=2))
    assert rows(rd.read_json_array(spark, str(table)), "old_code", "new_code") == [("601313", "601360")]


def test_objects_at_any_depth(spark):
    doc = json.dumps({"a": [{"k": 1, "b": {"c": [{"k": 2}, 5]}}], "z": {"k": {"k": 3}}})
    got = rd.objects_with_key(spark.createDataFrame([("d", doc)], "id string, p string"), "p", "k")
    found = [r["object_json"] for r in got.orderBy("position").collect()]
    assert [json.loads(x)["k"] for x in found] == [1, 2, {"k": 3}, 3]


def test_header_aliases(spark):
    sheet = spark.createDataFrame([("x", "000001", "主板")], "`公司` string, `A股 代码` string, `板块` string")
    aliases = {"code": ["A股代码", "证券代码"], "board": ["板块"]}
    assert rows(rd.resolve_headers(sheet, aliases, ["code"])) == [("000001", "主板")]
    with pytest.raises(rd.HeaderError):
        rd.resolve_headers(sheet, {"date": ["上市日期"]}, ["date"])


def test_manifests_digests_and_lists(spark, tmp_path):
    for name, n in [("a_sources.json", 1), ("b_sources.json", 2)]:
        (tmp_path / name).write_text(json.dumps({"shard": n, "files": [{"file": f"f{n}", "rows": n}]}, indent=1))
    ddl = T.StructType.fromDDL("shard INT, files ARRAY<STRUCT<file: STRING, rows: BIGINT>>")
    entries = rd.manifest_entries(rd.read_manifests(spark, str(tmp_path / "*_sources.json"), ddl), "files")
    assert rows(entries, "manifest", "shard", "file", "rows") == [("a_sources.json", 1, "f1", 1), ("b_sources.json", 2, "f2", 2)]
    digests = rd.file_digests(spark, str(tmp_path / "*_sources.json"))
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*_sources.json")}
    assert {r["file"]: r["sha256"] for r in digests.collect()} == want
    (tmp_path / "sums.txt").write_text("abc  manifest.json\n\ndef canonical:x y\n")
    assert rows(rd.read_digest_list(spark, str(tmp_path / "sums.txt"))) == [("canonical:x y", "def"), ("manifest.json", "abc")]


def test_report_sink(spark, folder):
    wr.write_report(spark.createDataFrame([("G1", True, None)], "gate string, pass boolean, note string"), folder)
    assert [json.loads(r[0]) for r in spark.read.text(folder).collect()] == [{"gate": "G1", "pass": True, "note": None}]


def test_rank_shards_match_a_sorted_list(spark):
    codes = [f"{i * 37 % 1000:06d}" for i in range(60)]
    df = spark.createDataFrame([("SSE" if i % 2 else "SZSE", c) for i, c in enumerate(codes)], "exchange string, code string")
    got = wr.rank_shards(df, schema.SECURITY, F.concat("exchange", F.substring("code", 1, 4)), 7)
    order = sorted((r["exchange"], r["code"]) for r in df.collect())
    assert {(r["exchange"], r["code"]): r["shard"] for r in got.collect()} == {k: i % 7 for i, k in enumerate(order)}
    assert df.select(wr.hash_shard(4, "exchange", "code").alias("s")).where("s < 0 or s > 3").count() == 0


def test_checkpoint_goes_to_the_named_folder(spark):
    cut = wr.cut_lineage(spark.range(5))
    assert cut.count() == 5 and spark.sparkContext.getCheckpointDir().startswith(
        ("file:" + wr.shared_folder(spark), wr.shared_folder(spark)))


def test_broken_payloads_are_violations(spark):
    docs = spark.createDataFrame([("a", '{"k": 1}'), ("b", "{broken"), ("c", None)], "id string, p string")
    assert rows(rd.objects_with_key(docs, "p", "k"), "id", "object_json") == [("a", '{"k": 1}')]
    assert checks(rd.unreadable_payloads(docs, "p", "id")) == [("payload is no JSON", "b"), ("payload is no JSON", "c")]
