"""What was known when: as-of filters and the latest version of a fact."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import FOREVER

PRICE_KEYS = ("isin", "venue", "trade_date")
ACTION_KEYS = ("isin", "action_type", "ex_date", "qualifier", "source_id")
VERDICT_KEYS = ("venue", "trade_date")


def known_as_of(df: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Rows knowable on ``as_of``, that day included; without one, all. The comparison reaches the scan."""
    return df.where(F.col("as_of_date") <= F.lit(str(as_of or FOREVER)).cast("date"))


def first_of_group(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group; ``order`` must settle every tie. Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_version(df: DataFrame, keys: Sequence[str], as_of: date | str | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """The newest version of each fact that was known on ``as_of``.

    The filter comes first: a later correction must not hide an earlier version. Ties on the as-of date fall
    to ``ties``, in order.
    """
    return first_of_group(known_as_of(df, as_of), keys, F.col("as_of_date").desc(), *ties)


def latest_price(prices: DataFrame, as_of: date | str | None = None) -> DataFrame:
    return latest_version(prices, PRICE_KEYS, as_of)


def latest_delivery(deliveries: DataFrame, as_of: date | str | None = None) -> DataFrame:
    return latest_version(deliveries, PRICE_KEYS, as_of)


def latest_action(actions: DataFrame, as_of: date | str | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """The newest version by source and qualifier; ``adjustment_factor`` is its ratio, null for dividends."""
    from tidemark.functions.scalars import ratio

    latest = latest_version(actions, ACTION_KEYS, as_of, ties)
    return latest.withColumn("adjustment_factor", F.when(F.col("ratio_from").isNotNull() & F.col("ratio_to").isNotNull(), ratio(F.col("ratio_from"), F.col("ratio_to"))))


def latest_verdict(days: DataFrame, as_of: date | str | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    return latest_version(days, VERDICT_KEYS, as_of, ties)


def complete_days_only(facts: DataFrame, days: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Facts of days that the latest verdict calls complete; an opt-in filter."""
    return facts.join(latest_verdict(days, as_of).where("is_complete").select(*VERDICT_KEYS), list(VERDICT_KEYS), "left_semi")
