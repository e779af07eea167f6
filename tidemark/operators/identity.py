"""Who an instrument is: listings, lookups and the primary venue, all interval-valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_isin
from tidemark.operators.asof import first_of_group
from tidemark.schemas import FOREVER, SETTLED_AFTER_DAYS, TURNOVER_WINDOW_DAYS

LINE = ("isin", "venue", "line")


class UnresolvableInstrument(ValueError):
    """Rows whose instrument can't be named."""


def unresolvable(bars: DataFrame) -> DataFrame:
    """Rows whose code is no ISIN; null is none."""
    return bars.where(F.col("isin").isNull() | ~is_isin(F.col("isin")))


def require_resolvable(bars: DataFrame) -> DataFrame:
    """``bars``, or an error with the count and first five of the codes that are no ISIN."""
    bad = unresolvable(bars)
    n = bad.count()
    if n:
        first = [r.isin for r in bad.select("isin").distinct().orderBy(F.col("isin").asc_nulls_last()).limit(5).collect()]
        raise UnresolvableInstrument(f"{n} rows without a valid ISIN: {first}")
    return bars


def derive_instruments(bars: DataFrame, names: DataFrame | None = None, country: str = "IN") -> DataFrame:
    """One row an ISIN; the name falls back to the ISIN."""
    found = bars.select("isin").distinct()
    found = found.join(names.select("isin", "name"), "isin", "left") if names is not None else found.withColumn("name", F.lit(None).cast("string"))
    return found.select("isin", F.coalesce("name", "isin").alias("name"), F.lit(None).cast("string").alias("sector"), F.lit(country).alias("country"), F.lit("equity").alias("instrument_type"))


def choose_names(names: DataFrame) -> DataFrame:
    """One name an ISIN from (isin, name, is_current_format, venue_order, trade_date): a current file's last name, else the first old one."""
    current = names.where("is_current_format").groupBy("isin").agg(F.max_by("name", F.struct("venue_order", "trade_date", "name")).alias("current"))
    old = names.where("NOT is_current_format").groupBy("isin").agg(F.min_by("name", F.struct("trade_date", "venue_order", "name")).alias("old"))
    return current.join(old, "isin", "full").select("isin", F.coalesce("current", "old").alias("name"))


def listing_spells(bars: DataFrame, order: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Runs of one symbol on a venue's line: isin, venue, line, run, symbol, scrip_code, first_day, last_day.

    A symbol that comes back begins a new run. ``order`` must settle the order of a line's rows.
    """
    lined = bars.withColumn("line", F.coalesce("scrip_code", F.lit("")))
    w = Window.partitionBy(*LINE).orderBy(*order)
    changed = F.lag("local_symbol").over(w).isNull() | (F.lag("local_symbol").over(w) != F.col("local_symbol"))
    runs = lined.withColumn("_new", changed.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*LINE, "run").agg(F.min("local_symbol").alias("symbol"), F.min("scrip_code").alias("scrip_code"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


def absorb_untickered(spells: DataFrame) -> DataFrame:
    """Fold a line's first run, if its symbol is only the line's code, into the run after it."""
    w = Window.partitionBy(*LINE).orderBy("run")
    n = Window.partitionBy(*LINE)
    bare = (F.first("symbol").over(w) == F.col("line")) & (F.count("*").over(n) > 1)
    marked = spells.withColumn("_at", F.row_number().over(w)).withColumn("_bare", bare).withColumn("_before", F.lag("first_day").over(w))
    return marked.where(~(F.col("_bare") & (F.col("_at") == 1))).withColumn("first_day", F.when(F.col("_bare") & (F.col("_at") == 2), F.col("_before")).otherwise(F.col("first_day"))).drop("_at", "_bare", "_before")


def last_days(bars: DataFrame) -> DataFrame:
    return bars.groupBy("venue").agg(F.max("trade_date").alias("venue_last_day"))


def derive_listings(bars: DataFrame, venue_last_day: DataFrame | None = None, order: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Listings with closed intervals: renamed at the end of a run, delisted 90 days after the last bar, else open.

    A venue without a last day is an error, raised when the rows are read.
    """
    spells = absorb_untickered(listing_spells(bars, order))
    joined = spells.join(venue_last_day if venue_last_day is not None else last_days(bars), "venue", "left")
    known = F.when(F.col("venue_last_day").isNull(), F.raise_error(F.concat(F.lit("no last trading day for venue "), "venue"))).otherwise(F.col("venue_last_day"))
    renamed = F.lead("run").over(Window.partitionBy(*LINE).orderBy("run")).isNotNull()
    flagged = joined.withColumn("_renamed", renamed).withColumn("_stopped", F.col("last_day") < F.date_sub(known.cast("date"), SETTLED_AFTER_DAYS))
    closed = F.col("_renamed") | F.col("_stopped")
    return flagged.select(
        "isin", F.col("venue").alias("exchange"), F.col("symbol").alias("local_symbol"), "scrip_code", F.col("first_day").alias("listing_date"),
        F.when(closed, F.col("last_day")).alias("delisting_date"), F.when(F.col("_renamed"), "renamed").when(F.col("_stopped"), "delisted").alias("closure_reason"),
    )


def in_force(bars: DataFrame, listings: DataFrame) -> DataFrame:
    """Bars with the symbol listed on their day; both ends of a listing count."""
    l = listings.select(F.col("isin").alias("_isin"), "exchange", F.col("local_symbol").alias("listed_symbol"), "listing_date", "delisting_date")
    on = (F.col("isin") == F.col("_isin")) & (F.col("venue") == F.col("exchange")) & (F.col("trade_date") >= F.col("listing_date")) & (F.col("delisting_date").isNull() | (F.col("trade_date") <= F.col("delisting_date")))
    return bars.join(l, on).drop("_isin", "exchange")


def matched(points: DataFrame, spans: DataFrame, keys: Sequence[str], day: str, start: str, end: str) -> DataFrame:
    """How many spans hold each point: ``keys``, ``day``, ``matches`` and ``span``, the span's other columns where it is one.

    Both ends of a span count, a null end is open, and a null day or key is in none. Spans are cut into the calendar
    years that they touch and met by equality on key and year, so a span is compared with the days of its own years,
    not with all of its key; an open one ends with the last point. Points are merged first, so repeated ones count once.
    """
    single = points.select(*keys, F.col(day).alias("_day")).distinct().withColumn("_year", F.year("_day"))
    last = points.agg(F.max(F.year(day))).first()[0] or 0
    until = F.least(F.coalesce(F.year(end), F.lit(last)), F.lit(last))
    years = F.when(F.year(start) <= until, F.sequence(F.year(start), until)).otherwise(F.array().cast("array<int>"))
    others = [c for c in spans.columns if c not in keys]
    cut = spans.select(*keys, F.explode(years).alias("_year"), F.struct(*others).alias("_span"))
    hit = single.join(cut, [*keys, "_year"], "left")
    inside = (F.col("_day") >= F.col(f"_span.{start}")) & F.coalesce(F.col("_day") <= F.col(f"_span.{end}"), F.col("_span").isNotNull())
    found = hit.withColumn("_in", F.coalesce(inside, F.lit(False))).groupBy(*keys, "_year", "_day").agg(F.count_if("_in").alias("matches"), F.any_value(F.when(F.col("_in"), F.col("_span")), True).alias("span"))
    return found.select(*keys, F.col("_day").alias(day), "matches", F.when(F.col("matches") == 1, F.col("span")).alias("span"))


def listing_matches(bars: DataFrame, listings: DataFrame) -> DataFrame:
    """``isin``, ``venue``, ``trade_date``, ``matches`` and ``span`` (the listing in force, where it is exactly one)."""
    spans = listings.select("isin", F.col("exchange").alias("venue"), F.col("local_symbol").alias("listed_symbol"), "scrip_code", "listing_date", "delisting_date")
    return matched(bars, spans, ("isin", "venue"), "trade_date", "listing_date", "delisting_date")


def exactly_in_force(bars: DataFrame, listings: DataFrame) -> DataFrame:
    """Bars with ``listed_symbol``, ``listing_date`` and ``delisting_date`` of the one listing in force on their day.

    A bar that none, or more than one, holds is an error, raised when it is read: see ``listing_matches`` for all of them.
    """
    found = listing_matches(bars, listings)
    said = F.concat(F.col("matches").cast("string"), F.lit(" listings hold "), F.concat_ws(" ", "isin", "venue", F.col("trade_date").cast("string")))
    one = F.when(F.col("matches") == 1, F.col("span")).otherwise(F.raise_error(said))
    sure = found.select("isin", "venue", "trade_date", one.alias("span"))
    return bars.join(sure, ["isin", "venue", "trade_date"]).select(*(bars[c] for c in bars.columns), "span.listed_symbol", "span.listing_date", "span.delisting_date")


def resolve_dated_keys(rows: DataFrame, listings: DataFrame, venue: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the ISIN that their key stood for on their day, keys and days with none or several) of a venue's rows.

    ``rows`` have ``venue_key`` and ``trade_date``. A key that was handed on to another instrument resolves to each in
    its time. Several listings of one ISIN agree; of different ones they are ``ambiguous``, and none is ``unknown``.
    """
    keyed = listings.where(F.col("exchange") == venue).select(F.coalesce("scrip_code", "local_symbol").alias("venue_key"), "isin", "listing_date", "delisting_date")
    w = Window.partitionBy("venue_key", "isin").orderBy("listing_date", F.col("delisting_date").asc_nulls_last())
    reach = F.max(F.coalesce("delisting_date", F.lit(FOREVER).cast("date"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("listing_date") > F.date_add(F.least(reach, F.lit("9999-12-30").cast("date")), 1))).cast("int")
    runs = keyed.withColumn("_run", F.sum(fresh).over(w)).groupBy("venue_key", "isin", "_run").agg(F.min("listing_date").alias("listing_date"), F.max(F.coalesce("delisting_date", F.lit(FOREVER).cast("date"))).alias("_until"))
    merged = runs.select("venue_key", "isin", "listing_date", F.nullif("_until", F.lit(FOREVER).cast("date")).alias("delisting_date"))
    found = matched(rows, merged, ("venue_key",), "trade_date", "listing_date", "delisting_date")
    known = found.where("matches = 1").select("venue_key", "trade_date", "span.isin")
    left = found.where("matches <> 1").select("venue_key", "trade_date", F.when(F.col("matches") == 0, "unknown").otherwise("ambiguous").alias("reason"))
    return rows.join(known, ["venue_key", "trade_date"]), left


def overlaps(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans that end after the next one of their group starts; expected to be none."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last()))
    return spans.withColumn("next_start", following).where(F.col("next_start").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("next_start"))))


def venue_keys(listings: DataFrame) -> DataFrame:
    """The ISIN behind each venue's own key (scrip code, else symbol), of the newest listing."""
    keyed = listings.select("exchange", F.coalesce("scrip_code", "local_symbol").alias("venue_key"), "isin", "listing_date")
    return first_of_group(keyed, ["exchange", "venue_key"], F.col("listing_date").desc(), F.col("isin").desc()).select("exchange", "venue_key", "isin")


def resolve_keys(rows: DataFrame, dimension: DataFrame, venue: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an ISIN, distinct keys without one) of a venue's rows; the optimizer picks the join."""
    own = dimension.where(F.col("exchange") == venue).select("venue_key", "isin")
    return rows.join(own, "venue_key"), rows.join(own, "venue_key", "left_anti").select("venue_key").distinct()


def dominant_line(turnover: DataFrame) -> DataFrame:
    """The line with most turnover of each (isin, venue); ties go to the smallest line."""
    summed = turnover.groupBy("isin", "venue", "line").agg(F.sum(F.coalesce("turnover", F.lit(0))).alias("turnover"))
    return first_of_group(summed, ["isin", "venue"], F.col("turnover").desc(), F.col("line"))


def dominant_only(rows: DataFrame, dominant: DataFrame) -> DataFrame:
    """Rows of each instrument's dominant line at a venue."""
    return rows.join(dominant.select("isin", "venue", "line"), ["isin", "venue", "line"], "left_semi")


def first_bars(bars: DataFrame) -> DataFrame:
    """``isin`` and the first day that it traded, on any venue."""
    return bars.groupBy("isin").agg(F.min("trade_date").alias("first_day"))


def fresh_isins(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions whose ex-date is their instrument's first day: a new face value brings a new ISIN, without earlier history."""
    return actions.join(first_bars(bars), "isin").where("first_day = ex_date")


def computation_days(bars: DataFrame) -> DataFrame:
    """Month ends in the range of all bars, and its last day."""
    span = bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).where("a IS NOT NULL")
    months = span.select("a", "b", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.least(F.last_day("m"), "b").alias("computed_on")).distinct()


def trailing_turnover(bars: DataFrame, window_days: int = TURNOVER_WINDOW_DAYS) -> DataFrame:
    """Turnover of the ``window_days`` up to each computation day, for each (isin, venue).

    Days are summed first, and each day is copied to the few computation days that it counts for; these are
    looked up by month, an equi-join, not compared with all.
    """
    daily = bars.groupBy("isin", "venue", "trade_date").agg(F.sum(F.coalesce("turnover", F.lit(0))).alias("turnover"))
    days = computation_days(bars).withColumn("_month", F.trunc("computed_on", "month"))
    reach = window_days // 28 + 1
    copied = daily.withColumn("_month", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: F.add_months(F.trunc("trade_date", "month"), i))))
    inside = copied.join(days, "_month").where((F.col("trade_date") > F.date_sub("computed_on", window_days)) & (F.col("trade_date") <= F.col("computed_on")))
    return inside.groupBy("isin", "venue", "computed_on").agg(F.sum("turnover").alias("turnover"))


def leading_venue(trailing: DataFrame) -> DataFrame:
    return first_of_group(trailing, ["isin", "computed_on"], F.col("turnover").desc(), F.col("venue"))


def derive_primary_venue(bars: DataFrame, window_days: int = TURNOVER_WINDOW_DAYS) -> DataFrame:
    """Spans of the venue with most trailing turnover; equal neighbours fold into one, the last stays open."""
    leaders = leading_venue(trailing_turnover(bars, window_days))
    w = Window.partitionBy("isin").orderBy("computed_on")
    starts = leaders.withColumn("_before", F.lag("venue").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("venue")))
    return starts.select("isin", F.col("computed_on").alias("effective_from"), F.col("computed_on").alias("as_of_date"), F.lead("computed_on").over(w).alias("effective_to"), "venue")
