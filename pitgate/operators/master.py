"""The current security master, its independent controls, and the delisted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgate.functions.classify import szse_board, szse_security_class
from pitgate.functions.dates import strict_date
from pitgate.functions.identity import is_sse_main_code, six_digits
from pitgate.functions.text import clean_text, first_nonempty, squeeze
from pitgate.operators.checks import enforce_unique, gather, key_text, split_rows, violations
from pitgate.schema import MASTER, SECURITY

# The names under which the sources give a field, in order of preference.
SSE_ALIASES = {
    "code": ("A_STOCK_CODE", "SECURITY_CODE_A", "STOCK_CODE"),
    "name": ("COMPANY_ABBR", "SEC_NAME_CN", "SECURITY_ABBR_A"),
    "list_board": ("LIST_BOARD", "BOARD_CODE"),
    "listing_date": ("LIST_DATE", "LISTING_DATE", "A_LIST_DATE"),
}
SZSE_ALIASES = {
    "code": ("agdm", "zqdm", "gsdm", "code", "A股代码", "证券代码"),
    "name": ("agjc", "zqjc", "gsjc", "name", "A股简称", "证券简称", "公司简称"),
    "board_text": ("bk", "ssbk", "board", "板块", "市场板块"),
    "listing_date": ("agssrq", "ssrq", "listingDate", "上市日期"),
}
SHEET_ALIASES = {
    "code": ("A股代码", "证券代码", "股票代码"),
    "board": ("板块", "所属板块", "市场板块"),
}
DELISTED_HEADER = ("证券代码", "证券简称", "上市日期", "终止上市日期")
INVALID_QUOTE_CODE = "invalid code in quote control"


def _aliased(json: str, aliases: dict[str, tuple[str, ...]]):
    field = lambda name: F.get_json_object(json, f"$['{name}']")
    return [first_nonempty(*[field(n) for n in names]).alias(out) for out, names in aliases.items()]


def sse_master(rows: DataFrame, source_url: str) -> tuple[DataFrame, DataFrame]:
    """Master rows of the first venue from its list (``row_json`` per security).

    Rows of another board or with another kind of code drop out; a row without a name is a
    violation.
    """
    named = rows.select("row_json", *_aliased("row_json", SSE_ALIASES))
    kept = named.where(is_sse_main_code(F.col("code")) & (F.col("list_board").isNull() | (F.col("list_board") == "1")))
    bad = violations(kept.where("name is null"), "row missing name", F.concat(F.lit("SSE:"), "code"))
    master = kept.where("name is not null").select(
        F.lit("SSE").alias("exchange"), F.lit("MAIN").alias("board"), F.lit("A_SHARE").alias("security_type"),
        "code", clean_text(F.col("name")).alias("name"), strict_date(F.col("listing_date")).alias("listing_date"),
        F.lit(source_url).alias("source_url"), F.col("row_json").alias("source_row_json"),
        F.lit("OFFICIAL_SSE_STOCK_TYPE_1").alias("board_basis"))
    return master.select(*MASTER.fieldNames()), bad


def szse_master(objects: DataFrame, source_url: str) -> DataFrame:
    """Master rows of the second venue from the objects of its pages.

    ``objects``: page, position, object_json. A code given twice keeps its last object. The
    board field decides; without one the code prefix does, and the basis says which.
    """
    named = objects.select("page", "position", "object_json", *_aliased("object_json", SZSE_ALIASES))
    boarded = named.withColumn("_b", szse_board(F.col("board_text"), F.col("code")))
    kept = boarded.where(six_digits(F.col("code")) & F.col("name").isNotNull() & F.col("_b").isNotNull())
    last = kept.groupBy("code").agg(F.max_by(
        F.struct("name", "listing_date", "object_json", "_b"), F.struct("page", "position")).alias("r"))
    return last.select(
        F.lit("SZSE").alias("exchange"), "r._b.board", F.lit("A_SHARE").alias("security_type"), "code",
        clean_text(F.col("r.name")).alias("name"), strict_date(F.col("r.listing_date")).alias("listing_date"),
        F.lit(source_url).alias("source_url"), F.col("r.object_json").alias("source_row_json"),
        F.col("r._b.basis").alias("board_basis")).select(*MASTER.fieldNames())


def quote_control(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main-board codes of the quote list, an independent control of the first venue.

    ``quotes``: total, and ``list`` as an array of positional text arrays whose third item
    is the subtype. A cut list or a malformed code is a violation.
    """
    cut = violations(quotes.where(F.size("list") != F.col("total")), "quote control truncated",
                     F.lit("SSE"), F.size("list"))
    items = quotes.select(F.explode("list").alias("q")).select(
        F.trim(F.get("q", F.lit(0))).alias("code"), F.trim(F.get("q", F.lit(2))).alias("subtype"))
    short = violations(items.where("subtype is null"), "malformed quote row", F.coalesce("code", F.lit("")))
    shares = items.where("subtype = 'ASH'")
    ok = F.col("code").rlike("^6[0-9]{5}$")
    bad = violations(shares.where(~ok), INVALID_QUOTE_CODE, F.col("code"))
    codes = shares.where(ok).select(F.lit("SSE").alias("exchange"), "code").distinct()
    return codes, gather(cut, short, bad)


def sheet_control(sheet: DataFrame) -> DataFrame:
    """Main-board codes of the second venue's sheet (columns ``code`` and ``board``)."""
    cells = sheet.select(squeeze(F.col("code")).alias("code"), squeeze(F.col("board")).alias("board"))
    return cells.where(six_digits(F.col("code")) & F.col("board").contains("主板")).select(
        F.lit("SZSE").alias("exchange"), "code").distinct()


def sse_delisted(rows: DataFrame, source_url: str) -> tuple[DataFrame, DataFrame]:
    """Delisted securities of the first venue from its list (``row_json``, ``sha256``)."""
    field = lambda *names: clean_text(F.coalesce(
        *[F.nullif(F.get_json_object("row_json", f"$.{n}"), F.lit("")) for n in names]))
    typed = rows.select(
        F.lit("SSE").alias("exchange"), field("A_STOCK_CODE").alias("code"),
        field("COMPANY_ABBR", "SEC_NAME_CN").alias("name"),
        strict_date(field("LIST_DATE", "A_LIST_DATE")).alias("list_date"),
        strict_date(field("DELIST_DATE")).alias("delist_date"), field("LIST_BOARD").alias("_board"),
        F.lit(source_url).alias("source_url"), F.col("sha256").alias("source_sha256"),
        F.col("row_json").alias("source_payload"))
    good, bad = split_rows(typed, key_text(*SECURITY), {
        "invalid code": six_digits(F.col("code")), "non-main row": F.col("_board").isin("", "1"),
        "missing DELIST_DATE": F.col("delist_date").isNotNull(), "missing LIST_DATE": F.col("list_date").isNotNull()})
    once, twice = enforce_unique(good.drop("_board"), SECURITY, "duplicate delisted code")
    return once, gather(bad, twice)


def szse_delisted(table: DataFrame, source_url: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(delisted, violations, class counts)`` of the second venue's table of delisted codes.

    Only main-board shares are kept; a code of no known class is a violation.
    """
    code, name, listed, ended = (clean_text(F.col(c)) for c in DELISTED_HEADER)
    cells = table.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in DELISTED_HEADER]).isNotNull())
    typed = cells.select(
        F.lit("SZSE").alias("exchange"), code.alias("code"), name.alias("name"),
        strict_date(listed).alias("list_date"), strict_date(ended).alias("delist_date"),
        F.lit(source_url).alias("source_url"),
        F.to_json(F.struct(*[F.col(c) for c in DELISTED_HEADER])).alias("source_payload")
    ).withColumn("security_class", szse_security_class(F.col("code")))
    counts = typed.groupBy("security_class").agg(F.count(F.lit(1)).alias("n"))
    unknown = violations(typed.where("security_class = 'UNKNOWN'"), "unknown security class", key_text(*SECURITY))
    shares = typed.where("security_class = 'MAIN_A'").drop("security_class").withColumn(
        "source_sha256", F.sha2("source_payload", 256))
    good, bad = split_rows(shares, key_text(*SECURITY), {
        "missing date": F.col("list_date").isNotNull() & F.col("delist_date").isNotNull()})
    once, twice = enforce_unique(good, SECURITY, "duplicate delisted code")
    return once, gather(unknown, bad, twice), counts
