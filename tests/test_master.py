import json

from pitgate.operators import master as ms
from pitgate.sources.readers import objects_with_key, payload_rows
from tests.helpers import checks, day, names, rows


def listed(spark, text):
    return payload_rows(spark.createDataFrame([(text,)], "payload string"), "payload", [])


def test_first_venue_list(spark):
    text = ('cb({"result":[{"A_STOCK_CODE":"600718","COMPANY_ABBR":"Harbor","LIST_DATE":"1996-06-18"},'
            '{"A_STOCK_CODE":"688217","COMPANY_ABBR":"Lab"}]})')
    made, bad = ms.sse_master(listed(spark, text), "u")
    assert rows(made, "code", "name", "listing_date", "board_basis") == [
        ("600718", "Harbor", day("1996-06-18"), "OFFICIAL_SSE_STOCK_TYPE_1")]
    assert checks(bad) == []
    assert ms.sse_master(listed(spark, '{"result":[]}'), "u")[0].count() == 0


def test_first_venue_faults_and_other_boards(spark):
    text = json.dumps({"data": [{"STOCK_CODE": "600001", "A_STOCK_CODE": "-"}, {"A_STOCK_CODE": "600002", "COMPANY_ABBR": "x", "LIST_BOARD": "2"}]})
    made, bad = ms.sse_master(listed(spark, text), "u")
    assert made.count() == 0 and checks(bad) == [("row missing name", "SSE:600001")]


def test_second_venue_board_basis_and_last_page(spark):
    pages = [(1, json.dumps({"data": [
        {"agdm": "000729", "agjc": "Brewer", "ssbk": "主板"}, {"agdm": "300418", "agjc": "Pixel", "ssbk": "创业板"},
        {"x": {"agdm": "002173", "agjc": "Pearl"}}, {"agdm": "400017", "agjc": "other"}]}, ensure_ascii=False)),
        (2, json.dumps([{"zqdm": "002173", "zqjc": "&lt;LAST&gt; n", "上市日期": "20040625"}], ensure_ascii=False))]
    found = objects_with_key(spark.createDataFrame(pages, "page int, payload string"), "payload", "agdm", "zqdm")
    assert rows(ms.szse_master(found, "u"), "code", "name", "board_basis", "listing_date") == [
        ("000729", "Brewer", "OFFICIAL_SZSE_BOARD_FIELD", None), ("002173", "n", "DERIVED_CODE_PREFIX", day("2004-06-25"))]


def test_quote_control(spark):
    quotes = spark.createDataFrame([(4, [["600718", "a", "ASH"], ["688217", "b", "KSH"], ["60000", "c", "ASH"]])],
                                   "total int, list array<array<string>>")
    codes, bad = ms.quote_control(quotes)
    assert rows(codes) == [("SSE", "600718")]
    assert names(bad) == ["invalid code in quote control", "quote control truncated"]


def test_sheet_control(spark):
    sheet = spark.createDataFrame([(" 000729 ", "主 板"), ("300418", "创业板"), ("合计", "主板")], "code string, board string")
    assert rows(ms.sheet_control(sheet)) == [("SZSE", "000729")]


def test_second_venue_delisted_table(spark):
    cols = ", ".join(f"`{c}` string" for c in ms.DELISTED_HEADER)
    table = spark.createDataFrame([
        ("000033", "a", "1994-01-03", "2017-07-07"), ("200041", "b", "1994-01-03", "2017-07-07"),
        ("001105", "c", "1994-01-03", "20170707"), ("", "", "", "")], cols)
    made, bad, counts = ms.szse_delisted(table, "u")
    assert rows(made, "code", "delist_date") == [("000033", day("2017-07-07"))] and checks(bad) == []
    assert dict(rows(counts)) == {"MAIN_A": 1, "MAIN_B": 1, "MAIN_CDR": 1}
    strange = spark.createDataFrame([("300418", "a", "1994-01-03", "2017-07-07"), ("000047", "b", "x", "2017-07-07")], cols)
    assert names(ms.szse_delisted(strange, "u")[1]) == ["missing date", "unknown security class"]


def test_first_venue_delisted_faults(spark):
    text = json.dumps({"result": [
        {"A_STOCK_CODE": "600001", "COMPANY_ABBR": "x", "LIST_BOARD": "1", "LIST_DATE": "19980122", "DELIST_DATE": "20091229"},
        {"A_STOCK_CODE": "600002", "LIST_DATE": "19980122", "DELIST_DATE": "-"},
        {"A_STOCK_CODE": "600003", "LIST_BOARD": "2", "LIST_DATE": "19980122", "DELIST_DATE": "20091229"}]})
    source = payload_rows(spark.createDataFrame([(text, "s")], "payload string, sha256 string"), "payload", [])
    made, bad = ms.sse_delisted(source, "u")
    assert rows(made, "code", "list_date", "delist_date") == [("600001", day("1998-01-22"), day("2009-12-29"))]
    assert names(bad) == ["missing DELIST_DATE", "non-main row"]
