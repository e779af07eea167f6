"""The staging and intermediate models as temporary views for SQL, and marts as tables.

A set of views answers for one as-of date, given when they are made; views of another date take other names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import asof, spreads

INSTRUMENT_COLUMNS = ("isin", "name", "sector", "country", "instrument_type")
LISTING_COLUMNS = ("isin", "exchange", "local_symbol", "scrip_code", "listing_date", "delisting_date", "closure_reason")


def models(facts: dict[str, DataFrame], as_of: str | None = None) -> dict[str, DataFrame]:
    """Each model that the facts given allow: staging, then intermediate on top of it.

    Instruments and listings have no as-of date: they are projected as they are.
    """
    staged: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
        "stg_price_daily": ("price_daily", lambda t: asof.latest_price(t, as_of)),
        "stg_delivery_daily": ("delivery_daily", lambda t: asof.latest_delivery(t, as_of)),
        "stg_corporate_actions": ("corporate_action", lambda t: asof.latest_action(t, as_of)),
        "stg_trading_day": ("trading_day", lambda t: asof.latest_verdict(t, as_of)),
        "stg_instruments": ("instrument_master", lambda t: t.select(*INSTRUMENT_COLUMNS)),
        "stg_listings": ("listing", lambda t: t.select(*LISTING_COLUMNS)),
    }
    out = {name: make(facts[table]) for name, (table, make) in staged.items() if table in facts}
    if "stg_price_daily" in out:
        out["int_venue_spread"] = spreads.venue_spread(out["stg_price_daily"])
    if "stg_delivery_daily" in out and "stg_price_daily" in out:
        out["int_delivery_participation"] = spreads.delivery_participation(out["stg_price_daily"], out["stg_delivery_daily"])
    return out


def create_views(facts: dict[str, DataFrame], as_of: str | None = None, suffix: str = "") -> list[str]:
    """Register the models as temporary views; plans are inlined, so a query over several is optimised as one."""
    made = models(facts, as_of)
    for name, df in made.items():
        df.createOrReplaceTempView(name + suffix)
    return [name + suffix for name in made]


def write_marts(spark: SparkSession, marts: dict[str, str], root: str) -> dict[str, DataFrame]:
    """Run each mart's SQL over the views and keep the result as a table below ``root``; the tables are returned."""
    for name, sql in marts.items():
        spark.sql(sql).write.mode("overwrite").parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in marts}
