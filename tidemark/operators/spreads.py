"""Models over the latest versions: spreads between venues and delivery participation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import percent, spread_bps


def venue_spread(latest: DataFrame, first: str = "BSE", second: str = "NSE") -> DataFrame:
    """Closes of two venues side by side, with their spread; instruments on one venue alone drop out.

    One aggregation pivots the closes, so there is no self-join. ``as_of_date`` is the newest of the group.
    """
    one = lambda v: F.max(F.when(F.col("venue") == v, F.col("close")))
    wide = latest.groupBy("isin", "trade_date").agg(F.max("as_of_date").alias("as_of_date"), one(first).alias("bse_close"), one(second).alias("nse_close"))
    return wide.where("bse_close IS NOT NULL AND nse_close IS NOT NULL").withColumn("spread_bps", spread_bps(F.col("bse_close"), F.col("nse_close")))


def delivery_participation(latest: DataFrame, delivered: DataFrame) -> DataFrame:
    """Delivered share of each bar's volume; bars without a delivery figure drop out, zero volume gives null."""
    d = delivered.select("isin", "venue", "trade_date", F.col("as_of_date").alias("_d"), "delivery_quantity")
    joined = latest.join(d, ["isin", "venue", "trade_date"])
    return joined.select("isin", "venue", "trade_date", F.greatest("as_of_date", "_d").alias("as_of_date"), "volume", "delivery_quantity", percent(F.col("delivery_quantity"), F.col("volume")).alias("delivery_pct"))
