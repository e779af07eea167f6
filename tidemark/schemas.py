"""Table schemas, and the constants that the rules use."""

from __future__ import annotations

import re

from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

# Patterns, lists, limits and windows that results depend on.
ISIN_PATTERN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
VENUE_PATTERN = "^[A-Z][A-Z0-9]{1,11}$"
COUNTRY_PATTERN = "^[A-Z]{2}$"
INSTRUMENT_TYPES = ("equity", "preference_share", "debt", "etf", "warrant", "right")
CLOSURE_REASONS = ("delisted", "renamed", "merged")
ACTION_TYPES = ("split", "bonus", "consolidation", "rights", "dividend")
COUNT_CHANGING = ("split", "bonus", "consolidation")
OUTCOMES = ("succeeded", "not_published", "failed")
EQUITY_SERIES = {
    "BSE": ("A", "B", "M", "MS", "MT", "P", "R", "T", "TS", "X", "XT", "Z", "ZP", "ZY"),
    "NSE": ("EQ", "BE", "BZ", "SM", "ST"),
}
DIVERGENCE_LIMIT_BPS = 500
TRUNCATION_FRACTION = 0.5
SETTLED_AFTER_DAYS = 90
TURNOVER_WINDOW_DAYS = 90
FOREVER = "9999-12-31"

# What a verdict on a day says of it.
NO_BARS = "empty day"
FEW_BARS = "%s bars instead of %s or more"
MISDATED = "bars dated on another day"
APART = "%s instruments whose venues disagree, by %s bps at most"


_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "short": ShortType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType()}


def _schema(text: str) -> StructType:
    """A schema of ``name type`` pairs, without a session (which Spark's own parser needs)."""

    def kind(name: str) -> DataType:
        decimal = re.fullmatch(r"decimal\((\d+),(\d+)\)", name)
        return DecimalType(*map(int, decimal.groups())) if decimal else _TYPES[name]

    return StructType([StructField(n, kind(t)) for n, t in (pair.split(" ") for pair in text.split(", "))])


BAR = _schema(
    "isin string, venue string, trade_date date, as_of_date date, local_symbol string, scrip_code string, open decimal(18,4), high decimal(18,4), "
    "low decimal(18,4), close decimal(18,4), previous_close decimal(18,4), volume long, turnover decimal(20,2), trade_count long"
)
PRICE_DAILY = _schema(
    "isin string, venue string, trade_date date, as_of_date date, open decimal(18,4), high decimal(18,4), low decimal(18,4), close decimal(18,4), "
    "previous_close decimal(18,4), volume long, turnover decimal(20,2), trade_count long"
)
DELIVERY_DAILY = _schema("isin string, venue string, trade_date date, as_of_date date, delivery_quantity long")
CORPORATE_ACTION = _schema(
    "isin string, action_type string, ex_date date, source_id string, as_of_date date, qualifier string, ratio_from decimal(18,6), ratio_to decimal(18,6), dividend_amount decimal(18,4)"
)
INSTRUMENT_MASTER = _schema("isin string, name string, sector string, country string, instrument_type string")
LISTING = _schema("isin string, exchange string, local_symbol string, scrip_code string, listing_date date, delisting_date date, closure_reason string")
LISTING_SUSPENSION = _schema("isin string, exchange string, suspended_from date, suspended_to date, as_of_date date, reason string")
PRIMARY_VENUE = _schema("isin string, effective_from date, as_of_date date, effective_to date, venue string")
TRADING_DAY = _schema("venue string, trade_date date, as_of_date date, is_complete boolean, bars int, divergent_instruments int, detail string")
SOURCE_REGISTRY = _schema("source_id string, tier short, sebi_curation_ref string, base_url string, requests_per_second decimal(6,3), cache_policy string, owner_notes string")
SCHEMA_VERSION = _schema("source_id string, effective_from date, version string, effective_to date")
INGESTION_LOG = _schema("source_id string, partition string, fetched_at timestamp, outcome string, row_count long, detail string")

TABLES = {
    "instrument_master": INSTRUMENT_MASTER, "listing": LISTING, "listing_suspension": LISTING_SUSPENSION, "instrument_primary_venue": PRIMARY_VENUE, "price_daily": PRICE_DAILY,
    "delivery_daily": DELIVERY_DAILY, "corporate_action": CORPORATE_ACTION, "source_registry": SOURCE_REGISTRY, "source_schema_version": SCHEMA_VERSION, "trading_day": TRADING_DAY, "ingestion_log": INGESTION_LOG,
}
