"""Column functions of the market rules; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import ISIN_PATTERN


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_zeros(c: Column) -> Column:
    """Without leading zeros; all zeros give ``0``."""
    return F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))


def is_isin(c: Column) -> Column:
    return c.rlike(ISIN_PATTERN)


def half_even(c: Column, places: int = 4) -> Column:
    return F.bround(c, places)


def ratio(numerator: Column, denominator: Column, places: int = 6) -> Column:
    """Quotient rounded half away from zero; null where either side is, or the divisor is 0."""
    return F.round(numerator.cast("decimal(20,6)") / F.nullif(denominator.cast("decimal(18,6)"), F.lit(0)), places)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole in four places, half away from zero, in decimals; null where the whole is 0."""
    return F.round((part.cast("decimal(19,0)") * 100).cast("decimal(22,0)") / F.nullif(whole.cast("decimal(19,0)"), F.lit(0)), 4)


def spread_bps(a: Column, b: Column) -> Column:
    """10,000 * |a - b| / their mean, in four places, half away from zero, in decimals; a mean of 0 is an error."""
    a, b = a.cast("decimal(18,4)"), b.cast("decimal(18,4)")
    return F.round((F.abs(a - b) * 20_000).cast("decimal(24,4)") / (a + b), 4)


def no_places(c: Column) -> Column:
    """A number without decimals, ties to even, and without thousands separators."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(""))


def market_date(c: Column, pattern: str) -> Column:
    """A day written in ``pattern``; years of two digits from 69 on are of the last century."""
    day = F.to_date(F.trim(c), pattern)
    if "yyyy" in pattern:
        return day
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
