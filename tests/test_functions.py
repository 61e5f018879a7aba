import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pitgate.functions import classify, dates, identity, numbers, text


def one(spark, build, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw, want", [
    ("&lt;b&gt;A&amp;lt; &#65;&#x4e2d;", "A&lt; A中"),
    ("&#38;lt; x", "&lt; x"),
    (" a　 b\n c<br/>d ", "a b cd"),
    ("&#55296;&#0;", "��"),
    (None, ""),
])
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text, raw) == want


def test_references_decode_as_browsers_do(spark):
    import html
    import random

    rng = random.Random(3)
    parts = ["&copy;", "&amp", "&ampx;", "&notit;", "&nope;", "&#00000039;", "&#x00000027;", "&#150;", "&#0;", "&#x110000;", "&#xD800",
             "&#128512;", "&#7;", "&", "&&", "a b", "&lt;&gt;", "&#", "&#x", "&frac12", "é;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.unescape(F.col("t"))).collect()] == [html.unescape(t) for t in texts]


def test_closed_references_only(spark):
    closed = lambda c: text.clean_text(c, closed=True)
    assert one(spark, closed, "a &amp b &ampx; &amp;lt; &copy; &#65; &#65 &am") == "a &amp b &ampx; &lt; © A &#65 &am"


@pytest.mark.parametrize("raw, strict, lenient", [
    ("1,234.5", "1234.500000", "1234.500000"), ("--", None, "0.000000"), ("", None, "0.000000"),
    ("None", None, "0.000000"), ("abc", None, "0.000000"), (None, None, "0.000000"), ("-3", "-3.000000", "-3.000000"),
    ("200.0000001", None, "200.0000001"), ("10.12345678", None, "10.12345678"), ("1234567890123", None, "1234567890123"),
    ("4.5000000", "4.500000", "4.5"), ("0.0000000000001", None, "0"),
])
def test_strict_and_lenient_numbers(spark, raw, strict, lenient):
    assert one(spark, numbers.strict_decimal, raw) == (None if strict is None else Decimal(strict))
    assert one(spark, numbers.lenient_decimal, raw) == Decimal(lenient)


def test_unit_conversion(spark):
    ten_thousand = lambda c: numbers.non_negative_integer(c, 10_000)
    assert one(spark, ten_thousand, "1.25") == 12500
    assert one(spark, ten_thousand, "1.00005") is None
    assert one(spark, ten_thousand, "-1") is None
    assert one(spark, ten_thousand, "0.00001") is None and one(spark, numbers.non_negative_integer, "200.0000001") is None
    assert one(spark, numbers.lenient_decimal, "9" * 30) is None
    assert one(spark, numbers.non_negative_price, "-0.5") is None


@pytest.mark.parametrize("raw, strict, lenient", [
    ("20260714", "2026-07-14", "2026-07-14"), ("2026-07-14", "2026-07-14", "2026-07-14"),
    ("2026/07/14", None, "2026-07-14"), ("2026.07.14 00:00", None, "2026-07-14"),
    ("1970-01-01", "1970-01-01", None), ("2026-13-40", None, None), ("-", None, None), (None, None, None),
])
def test_dates(spark, raw, strict, lenient):
    of = lambda s: None if s is None else dt.date.fromisoformat(s)
    assert one(spark, dates.strict_date, raw) == of(strict)
    assert one(spark, dates.lenient_date, raw) == of(lenient)


def test_date_in_text(spark):
    assert one(spark, dates.date_in_text, "截至2026年7月24日") == dt.date(2026, 7, 24)
    assert one(spark, dates.date_in_text, "no date") is None
    assert one(spark, dates.date_in_text, "2026-2-30") is None


def test_first_nonempty(spark):
    df = spark.createDataFrame([("-", "", " x "), (None, "y", "z")], "a string, b string, c string")
    got = [r[0] for r in df.select(text.first_nonempty(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["x", "y"]


@pytest.mark.parametrize("code, want", [
    ("000000", "UNKNOWN"), ("000004", "MAIN_A"), ("002001", "MAIN_A"), ("003001", "MAIN_A"), ("004999", "MAIN_A"),
    ("001200", "MAIN_A"), ("001001", "MAIN_CDR"), ("001199", "MAIN_CDR"), ("200018", "MAIN_B"), ("300001", "UNKNOWN"),
    ("12", "UNKNOWN"),
])
def test_security_class(spark, code, want):
    assert one(spark, classify.szse_security_class, code) == want


def test_board_basis(spark):
    df = spark.createDataFrame(
        [("主板", "000001"), (None, "002001"), ("创业板", "300001"), ("", "300002"), ("其他", "400001")],
        "board string, code string")
    got = [r["c"] and tuple(r["c"]) for r in df.select(
        classify.szse_board(F.col("board"), F.col("code")).alias("c")).collect()]
    assert got == [("MAIN", "OFFICIAL_SZSE_BOARD_FIELD"), ("MAIN", "DERIVED_CODE_PREFIX"), None, None, None]


def test_scope_and_codes(spark):
    df = spark.createDataFrame([("SSE", "600000"), ("SSE", "688001"), ("SZSE", "001001"), ("SZSE", "000001"), ("X", "600000")],
                               "e string, c string")
    got = [tuple(r) for r in df.select(identity.in_scope(F.col("e"), F.col("c")), identity.is_sse_main_code(F.col("c")),
                                       identity.supplier_code(F.col("e"), F.col("c"))).collect()]
    assert got == [(True, True, "sh.600000"), (False, False, "sh.688001"), (False, False, "sz.001001"),
                   (True, False, "sz.000001"), (False, True, "sz.600000")]


def test_compact_key_holds_its_parts(spark):
    key = one(spark, lambda c: identity.compact_key(F.lit("SZSE"), c, F.lit(dt.date(2015, 1, 5))), "000001")
    assert key == (1 << 50) | (1 << 20) | dt.date(2015, 1, 5).toordinal()


def test_declared_differential(spark):
    told = '{"F007V":"限售股股东10派2.648元，流通股股东10派3.21元"}'
    for payload, want in [(told, True), ('{"F007V":"差异化"}', True), ('{"F007V":"10派1元"}', False),
                          ("差异化 but no JSON", True), ('{"note":"差异化"}', False), (None, False)]:
        assert one(spark, classify.declares_differential, payload) is want


def test_action_and_dividend_classes(spark):
    kinds = spark.range(1).select(
        classify.action_type(F.lit(1), F.lit(0), F.lit(2), F.lit(1)), classify.action_type(*[F.lit(0)] * 4),
        classify.dividend_class(F.lit(1), F.lit(0), F.lit(0)), classify.dividend_class(F.lit(1), F.lit(1), F.lit(0)),
        classify.dividend_class(F.lit(0), F.lit(0), F.lit(2)), classify.dividend_class(F.lit(0), F.lit(0), F.lit(0))).first()
    assert tuple(kinds) == ("CASH_DIVIDEND+CAPITAL_TRANSFER+RIGHTS_ISSUE", "", "CASH_DIVIDEND", "CASH_AND_STOCK_DISTRIBUTION",
                            "STOCK_DIVIDEND_OR_CAPITAL_TRANSFER", "DIVIDEND_RECORD_OTHER")


def test_canonical_json_sorts_and_keeps_nulls(spark):
    df = spark.createDataFrame([("x", None)], "b string, a string")
    assert df.select(identity.canonical_json(["b", "a"])).first()[0] == '{"a":null,"b":"x"}'
    entries = spark.range(1).select(identity.canonical_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))))
    assert entries.first()[0] == '{"a":"2","b":"1"}'


def test_exponents_move_the_point_before_the_test(spark):
    cases = {"1e-20": None, "1e-6": Decimal("0.000001"), "1e-7": None, "12.50e1": Decimal("125"), "1200e-3": Decimal("1.2"),
             "0e-30": Decimal("0"), "0.00e-99999999999": None, "1e-99999999999": None, "1e40": None,
             "-3.5E+2": Decimal("-350"), "1.0000000000000e0": Decimal("1"), "1.0000000000001e0": None, "1e": None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r["raw"]: r for r in rows.select(
        "raw", numbers.strict_decimal(F.col("raw")).alias("x"), numbers.non_negative_integer(F.col("raw")).alias("n")).collect()}
    assert {k: r["x"] for k, r in got.items()} == cases
    assert got["1e-20"]["n"] is None and got["12.50e1"]["n"] == 125 and got["-3.5E+2"]["n"] is None
