"""Integrity rules as named predicates, and checks that are expected to find nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as s


def _c(name: str) -> Column:
    return F.col(name)


def _both(a: str, b: str) -> Column:
    return _c(a).isNull() == _c(b).isNull()


def rules() -> dict[str, dict[str, Column]]:
    """For each table, what every row must meet; a rule that is null for a row holds for it."""
    bar_signs = reduce(lambda a, b: a & b, (_c(x) >= 0 for x in ("open", "high", "low", "close")))
    return {
        "instrument_master": {"isin_form": _c("isin").rlike(s.ISIN_PATTERN), "country_form": _c("country").rlike(s.COUNTRY_PATTERN), "type_known": _c("instrument_type").isin(*s.INSTRUMENT_TYPES)},
        "listing": {
            "exchange_form": _c("exchange").rlike(s.VENUE_PATTERN), "closes_after_opening": _c("delisting_date") >= _c("listing_date"), "reason_iff_closed": _both("delisting_date", "closure_reason"),
            "reason_known": _c("closure_reason").isin(*s.CLOSURE_REASONS),
        },
        "listing_suspension": {"ends_after_start": _c("suspended_to") >= _c("suspended_from")},
        "instrument_primary_venue": {"ends_later": _c("effective_to") > _c("effective_from"), "venue_form": _c("venue").rlike(s.VENUE_PATTERN)},
        # The close may lie outside the traded range: it is deliberately not bounded.
        "price_daily": {"high_over_low": _c("high") >= _c("low"), "high_over_open": _c("high") >= _c("open"), "low_under_open": _c("low") <= _c("open"), "prices_not_negative": bar_signs, "volume_not_negative": _c("volume") >= 0, "known_after_trade": _c("as_of_date") >= _c("trade_date")},
        "delivery_daily": {"delivery_not_negative": _c("delivery_quantity") >= 0},
        "corporate_action": {
            "type_known": _c("action_type").isin(*s.ACTION_TYPES), "amount_iff_dividend": (_c("action_type") == "dividend") == _c("dividend_amount").isNotNull(),
            "ratio_iff_not_dividend": (_c("action_type") != "dividend") == _c("ratio_from").isNotNull(), "ratio_whole": _both("ratio_from", "ratio_to"), "ratio_positive": (_c("ratio_from") > 0) & (_c("ratio_to") > 0),
        },
        "source_registry": {"tier_known": _c("tier").between(1, 4), "rate_positive": _c("requests_per_second") > 0},
        "source_schema_version": {"ends_after_start": _c("effective_to") >= _c("effective_from")},
        "trading_day": {"bars_not_negative": _c("bars") >= 0, "detail_iff_incomplete": _c("is_complete") == _c("detail").isNull()},
        "ingestion_log": {"outcome_known": _c("outcome").isin(*s.OUTCOMES), "rows_iff_success": (_c("outcome") == "succeeded") == _c("row_count").isNotNull()},
    }


def violations(df: DataFrame, table: str) -> DataFrame:
    """``rule`` and ``violations`` for each rule of ``table``, in one pass over the rows."""
    named = rules()[table]
    counts = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in named.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in named))).alias("x")).select("x.rule", "x.violations")


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df``, which fails when a row that breaks a rule is read."""
    broken = F.concat_ws(", ", *(F.when(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules()[table].items()))
    return df.withColumn("_broken", broken).where((F.col("_broken") == "") | F.raise_error(F.concat(F.lit(f"{table}: "), F.col("_broken"))).isNotNull()).drop("_broken")


def nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


def unaccepted(df: DataFrame, column: str, values: tuple) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def orphans(df: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; a null key refers to nothing and is no orphan."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return df.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def delivery_over_volume(latest: DataFrame, delivered: DataFrame) -> DataFrame:
    joined = latest.select("isin", "venue", "trade_date", "volume").join(delivered.select("isin", "venue", "trade_date", "delivery_quantity"), ["isin", "venue", "trade_date"])
    return joined.where("delivery_quantity > volume")


def wide_spreads(spreads: DataFrame, limit_bps: float = s.DIVERGENCE_LIMIT_BPS) -> DataFrame:
    return spreads.where(F.col("spread_bps") > limit_bps)


def shared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have; expected to be none where they should be disjoint."""
    return left.select(key).intersect(right.select(key))


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required columns that aren't there, sorted; names are compared without outer spaces."""
    return sorted(set(required) - {c.strip() for c in df.columns})


def lacking(headed: DataFrame, header: str, required) -> DataFrame:
    """A row with ``missing`` for each required column that a row's header (names between commas) doesn't name, outer spaces aside.

    The form of ``missing_columns`` for very many files at once: headers are data, and each is looked at in its row.
    """
    names = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda n: F.trim(n))
    return headed.select("*", F.explode(F.array_except(F.array(*(F.lit(n) for n in sorted(required))), names)).alias("missing"))
