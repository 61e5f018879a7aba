"""Table schemas, key declarations and the fixed rule values of the data model."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 6)
RATE = T.DecimalType(4, 2)

SECURITY = ("exchange", "code")


_TYPES = {
    "STRING": T.StringType(), "DATE": T.DateType(), "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(), "DECIMAL(18,6)": PRICE, "DECIMAL(4,2)": RATE,
}


def _struct(spec: str) -> T.StructType:
    """A schema from ``name TYPE, …`` without a session (``fromDDL`` needs one)."""
    fields = [item.split() for item in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


MASTER = _struct(
    "exchange STRING, board STRING, security_type STRING, code STRING, name STRING, "
    "listing_date DATE, source_url STRING, source_row_json STRING, board_basis STRING"
)
LIFECYCLE_EVENT = _struct(
    "exchange STRING, code STRING, event_type STRING, effective_date DATE, announced_at DATE, "
    "name STRING, source_url STRING, source_sha256 STRING, evidence_class STRING, source_payload STRING"
)
CODE_TRANSITION = _struct(
    "exchange STRING, old_code STRING, new_code STRING, effective_date DATE, old_name STRING, "
    "new_name STRING, source_url STRING, source_sha256 STRING, evidence_class STRING"
)
INTERVAL = _struct(
    "exchange STRING, code STRING, name STRING, listed_from DATE, listed_to_exclusive DATE, "
    "list_evidence_class STRING, delist_evidence_class STRING"
)
BAR = _struct(
    "exchange STRING, code STRING, trade_date DATE, open DECIMAL(18,6), high DECIMAL(18,6), "
    "low DECIMAL(18,6), close DECIMAL(18,6), volume_shares BIGINT, amount_cny BIGINT"
)
STATE = _struct(
    "exchange STRING, code STRING, trade_date DATE, tradable BOOLEAN, risk_warning BOOLEAN, "
    "preclose DECIMAL(18,6), pct_chg DECIMAL(18,6), limit_rule STRING, limit_up_rate DECIMAL(4,2), "
    "limit_down_rate DECIMAL(4,2), evidence STRING"
)
ACTION_COMPONENT = _struct(
    "exchange STRING, code STRING, ex_date DATE, record_date DATE, announcement_date DATE, "
    "action_component STRING, cash_per_share DECIMAL(18,6), bonus_per_share DECIMAL(18,6), "
    "transfer_per_share DECIMAL(18,6), rights_per_share DECIMAL(18,6), rights_price DECIMAL(18,6), "
    "rights_listing_date DATE, source_system STRING, source_id STRING, source_url STRING, "
    "source_sha256 STRING, source_payload STRING"
)
FACTOR_EVENT = _struct(
    "exchange STRING, code STRING, effective_date DATE, fore_adjust_factor DECIMAL(18,6), "
    "back_adjust_factor DECIMAL(18,6), adjust_factor DECIMAL(18,6), event_type STRING, "
    "cash_ps_before_tax DECIMAL(18,6), stock_ps DECIMAL(18,6), reserve_to_stock_ps DECIMAL(18,6), "
    "event_detail STRING, evidence STRING"
)

KEYS = {
    "master": ("exchange", "code"),
    "lifecycle_event": ("exchange", "code", "event_type", "effective_date"),
    "interval": ("exchange", "code"),
    "bar": ("exchange", "code", "trade_date"),
    "state": ("exchange", "code", "trade_date"),
    "action_ledger": ("exchange", "code", "ex_date"),
    "adjustment_chain": ("exchange", "code", "ex_date"),
    "factor_event": ("exchange", "code", "effective_date"),
}

AMOUNTS = ("cash_per_share", "bonus_per_share", "transfer_per_share")
RIGHTS = ("rights_per_share", "rights_price")


@dataclass(frozen=True)
class Rules:
    """Dates and tolerances of the data set.

    The defaults are fixed values: they have to equal the published rule dates for the
    results to be right. Tables on another calendar pass their own.
    """

    coverage_start: dt.date = dt.date(2015, 1, 1)
    coverage_end: dt.date = dt.date(2026, 7, 24)
    ipo_2014_start: dt.date = dt.date(2014, 1, 1)
    registration_start: dt.date = dt.date(2023, 4, 10)
    risk_warning_10pct_start: dt.date = dt.date(2026, 7, 6)
    delisting_reform: dt.date = dt.date(2020, 12, 31)
    component_tolerance: str = "0.00051"
    material_reference_delta: float = 0.01
    factor_change: float = 0.000001
    factor_mismatch: float = 0.01
    rebase_gap: float = 0.005
    tiny_unobserved: float = 0.0005
    match_days: int = 10


@dataclass(frozen=True)
class Overrides:
    """Officially announced one-off days (fixed values)."""

    relisting_first_day: tuple = field(
        default=(
            ("SSE", "601975", dt.date(2019, 1, 8)),
            ("SSE", "601399", dt.date(2020, 6, 8)),
            ("SZSE", "001267", dt.date(2021, 11, 17)),
        )
    )
    non_trading: tuple = field(
        default=(("SSE", "600656", dt.date(2016, 5, 12), "SSE_OFFICIAL_DELISTING_SCHEDULE"),)
    )
