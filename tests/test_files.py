import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pitgate.plans import gates as gt
from pitgate.schema import Rules
from pitgate.sources import files as fl
from tests.helpers import checks, rows

HEADER = "trade_date,code,close"


def line(day, code):
    return f"2020-01-{day:02d},{code:06d},1.5"


def test_digests_stream_in_chunks(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for i, size in enumerate((0, 1, 999, 1000, 5001)):
        data = rng.randbytes(size)
        (tmp_path / f"part{i}.bin").write_bytes(data)
        if size:
            want[f"part{i}.bin"] = (hashlib.sha256(data).hexdigest(), size)
    got = fl.digests(spark, str(tmp_path), chunk=1000)
    assert {r["file"]: (r["sha256"], r["bytes"]) for r in got.collect()} == want
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_order_and_header_of_each_file(spark, tmp_path):
    good = [line(d, c) for d in range(1, 9) for c in range(300)]
    swapped = good[:500] + [good[501], good[500]] + good[502:]
    texts = {
        "good": [HEADER, *good], "swapped": [HEADER, *swapped], "twice": [HEADER, *good[:10], good[9], *good[10:]],
        "renamed": ["trade_date,number,close", *good[:50]], "bare": good[:50], "quoted": ['"trade_date","code","close"', *good[:5]],
        "short": [HEADER, "2020-01-01", *good[:5]], "only": [HEADER]}
    for name, lines in texts.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(("\n".join(texts["swapped"]) + "\n").encode()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    got = {}
    for size in ("128m", "2k"):
        # With small blocks a file is many tasks, and the descent may lie between two of them.
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = fl.csv_orders(spark, str(tmp_path), HEADER.split(","), ["trade_date", "code"]).collect()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        got[size] = {r["file"].split("/")[-1]: (r["rows"], r["unread"], r["descents"], r["header_ok"],
                                                (r["first_descent"] or "").replace("\x1f", ":")) for r in found}
    assert got["128m"] == got["2k"] == {
        "good.csv": (2400, 0, 0, True, ""), "swapped.csv": (2400, 0, 1, True, "2020-01-02:000200"),
        "packed.csv.gz": (2400, 0, 1, True, "2020-01-02:000200"), "twice.csv": (2401, 0, 1, True, "2020-01-01:000009"),
        "renamed.csv": (50, 0, 0, False, ""), "bare.csv": (49, 0, 0, False, ""), "quoted.csv": (5, 0, 0, True, ""),
        "short.csv": (6, 1, 0, True, ""), "only.csv": (0, 0, 0, True, "")}


@pytest.mark.parametrize("width", [1, 3, 40])
def test_blocks_combine_to_the_whole(spark, width):
    rng = random.Random(width)
    keys = sorted(rng.sample(range(10000), 200))
    for _ in range(4):
        i = rng.randrange(199)
        keys[i], keys[i + 1] = keys[i + 1], keys[i]
    falls = [b for a, b in zip(keys, keys[1:]) if b <= a]
    cut = [keys[i:i + width] for i in range(0, 200, width)]
    blocks = [("f", i, len(c), 0, sum(b <= a for a, b in zip(c, c[1:])), None, f"{c[0]:05d}", f"{c[-1]:05d}",
               next((f"{b:05d}" for a, b in zip(c, c[1:]) if b <= a), None)) for i, c in enumerate(cut)]
    out = fl.file_orders(spark.createDataFrame(blocks, fl._BLOCK)).first()
    assert (out["rows"], out["descents"], out["header_ok"]) == (200, len(falls), None)
    assert (out["first_key"], out["last_key"], out["first_descent"]) == (f"{keys[0]:05d}", f"{keys[-1]:05d}", f"{falls[0]:05d}")


def test_parquet_rows_are_tested_in_stored_order(spark, tmp_path):
    ids = spark.range(0, 5000, 1, 1)
    ids.write.parquet(f"{tmp_path}/up")
    ids.sortWithinPartitions(F.desc("id")).write.parquet(f"{tmp_path}/down")
    for name, descents in (("up", 0), ("down", 4999)):
        scan = spark.read.parquet(f"{tmp_path}/{name}").select("id", "_metadata")
        whole = fl.file_orders(fl.block_orders(scan, F.lpad(F.col("id").cast("string"), 6, "0"))).first()
        assert (whole["rows"], whole["descents"], whole["header_ok"]) == (5000, descents, None)


def test_gate_reports_each_file_fault(spark):
    rules = Rules()
    years = range(rules.coverage_start.year, rules.coverage_end.year + 1)
    shape = "exchange string, year int, rows long, unread long, descents long, header_ok boolean, first_descent string"
    good = [(v, y, 5, 0, 0, True, None) for v in ("SSE", "SZSE") for y in years]
    assert checks(gt.bar_files_gate(spark.createDataFrame(good, shape), rules)) == []
    first, last = years[0], years[-1]
    bad = [("SSE", first, 5, 0, 2, True, "2015-02-03\x1f000007"), ("SSE", first + 1, 5, 0, 0, False, None),
           ("SSE", first + 2, 5, 3, 0, None, None), ("SSE", last + 1, 5, 0, 0, True, None),
           *[r for r in good if r[:2] not in {("SSE", first), ("SSE", first + 1), ("SSE", first + 2), ("SZSE", last)}]]
    found = gt.bar_files_gate(spark.createDataFrame(bad, shape), rules)
    assert checks(found) == sorted([
        ("key does not rise in its file", f"SSE:{first}"), ("unexpected header", f"SSE:{first + 1}"),
        ("unexpected header", f"SSE:{first + 2}"), ("row without a key", f"SSE:{first + 2}"),
        ("data file outside the coverage", f"SSE:{last + 1}"), ("year without data file", f"SZSE:{last}")])
    assert rows(found.where("key = 'SSE:2015' or detail like '%:%'"), "detail") == [("2015-02-03:000007",)]
