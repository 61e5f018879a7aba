"""Classifications written as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitgate.functions.identity import six_digits
from pitgate.functions.text import clean_text


def szse_board(board_text: Column, code: Column) -> Column:
    """``struct(board, basis)``; null where the row is not main board.

    An explicit board field beats the code prefix.
    """
    text = clean_text(board_text)
    growth = text.contains("创业") | code.rlike("^30[01]")
    basis = (
        F.when(growth, F.lit(None).cast("string"))
        .when(text.contains("主板"), F.lit("OFFICIAL_SZSE_BOARD_FIELD"))
        .when(code.rlike("^00[0-3]"), F.lit("DERIVED_CODE_PREFIX"))
    )
    return F.when(basis.isNotNull(), F.struct(F.lit("MAIN").alias("board"), basis.alias("basis")))


def szse_security_class(code: Column) -> Column:
    number = code.try_cast("int")
    return (
        F.when(~six_digits(code), F.lit("UNKNOWN"))
        .when(number.between(1001, 1199), F.lit("MAIN_CDR"))
        .when(number.between(1, 4999), F.lit("MAIN_A"))
        .when(code.startswith("200"), F.lit("MAIN_B"))
        .otherwise(F.lit("UNKNOWN"))
    )


def action_type(cash: Column, bonus: Column, transfer: Column, rights: Column) -> Column:
    """Ordered tags joined by '+'; '' for an action without economic terms."""
    return F.concat_ws(
        "+",
        F.when(cash > 0, F.lit("CASH_DIVIDEND")),
        F.when(bonus > 0, F.lit("BONUS_SHARE")),
        F.when(transfer > 0, F.lit("CAPITAL_TRANSFER")),
        F.when(rights > 0, F.lit("RIGHTS_ISSUE")),
    )


def dividend_class(cash: Column, stock: Column, reserve: Column) -> Column:
    shares = (stock > 0) | (reserve > 0)
    return (
        F.when((cash > 0) & shares, F.lit("CASH_AND_STOCK_DISTRIBUTION"))
        .when(cash > 0, F.lit("CASH_DIVIDEND"))
        .when(shares, F.lit("STOCK_DIVIDEND_OR_CAPITAL_TRANSFER"))
        .otherwise(F.lit("DIVIDEND_RECORD_OTHER"))
    )


def declares_differential(payload: Column) -> Column:
    """Whether a disclosure states different rates for different holders.

    The text is field F007V when the payload is JSON, else the payload itself.
    """
    is_json = F.try_parse_json(payload).isNotNull()
    text = F.when(is_json, F.coalesce(F.get_json_object(payload, "$.F007V"), F.lit(""))).otherwise(
        F.coalesce(payload, F.lit(""))
    )
    return text.contains("差异化") | (text.contains("限售股股东") & text.contains("流通股股东"))
