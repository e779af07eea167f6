"""What each instrument did over a range, and a small universe that shows every case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import first_of_group

ACTION_RATIO = 0.7
# Requirements in order, and how many instruments each takes.
QUOTAS = (("capital_action", 2), ("symbol_change", 1), ("delisted", 1), ("suspended", 1), ("bse_only", 3), ("short_history", 2), ("dual_listed", 25))


def weekdays(first: Column, last: Column) -> Column:
    """All days from Monday to Friday in a range, both ends included."""
    return F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)


def holidays(bars: DataFrame) -> DataFrame:
    """Weekdays of the range on which nobody traded."""
    days = bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).where("a IS NOT NULL").select(F.explode(weekdays(F.col("a"), F.col("b"))).alias("trade_date"))
    return days.join(bars.select("trade_date").distinct(), "trade_date", "left_anti")


def calendar_gaps(bars: DataFrame, keys: tuple[str, ...] = ("isin", "venue")) -> DataFrame:
    """The longest run of calendar days between neighbouring bars."""
    w = Window.partitionBy(*keys).orderBy("trade_date")
    return bars.withColumn("_gap", F.datediff("trade_date", F.lag("trade_date").over(w))).groupBy(*keys).agg(F.max("_gap").alias("gap"))


def _numbered(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """``bars`` with ``_gap``: the venue's trading days strictly between a bar and the one before it of its instrument.

    A venue's days are numbered once, so a gap is a difference of numbers; a venue has few days, whatever its bars.
    ``calendar`` holds the same (venue, trade_date) as ``bars`` where these are dear to make twice.
    """
    days = (bars if calendar is None else calendar).select("venue", "trade_date").distinct().withColumn("_no", F.row_number().over(Window.partitionBy("venue").orderBy("trade_date")))
    w = Window.partitionBy("isin", "venue").orderBy("trade_date")
    return bars.join(days, ["venue", "trade_date"]).withColumn("_gap", F.greatest(F.col("_no") - F.lag("_no").over(w) - 1, F.lit(0)))


def trading_gaps(bars: DataFrame) -> DataFrame:
    """The most of a venue's trading days strictly between neighbouring bars of an instrument."""
    return _numbered(bars).groupBy("isin", "venue").agg(F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap"))


def worst_ratios(bars: DataFrame) -> DataFrame:
    """The least close / previous close of an instrument at a venue, and the first day that has it."""
    rated = bars.where("previous_close > 0").withColumn("ratio", F.col("close").cast("double") / F.col("previous_close").cast("double"))
    return first_of_group(rated, ["isin", "venue"], F.col("ratio"), F.col("trade_date")).select("isin", "venue", F.col("ratio").alias("worst_ratio"), F.col("trade_date").alias("worst_ratio_day"))


def track_survey(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """First and last day, days, symbols, turnover, worst ratio and longest gap for each (isin, venue).

    One pass: the gap's window and the aggregate share their keys, so the bars are shuffled once. For ``calendar`` see ``_numbered``.
    """
    rated = F.when(F.col("previous_close") > 0, F.struct((F.col("close").cast("double") / F.nullif(F.col("previous_close"), F.lit(0)).cast("double")).alias("ratio"), F.col("trade_date").alias("day")))
    tracked = _numbered(bars.withColumn("_worst", rated), calendar).groupBy("isin", "venue").agg(
        F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count("*").alias("days"), F.size(F.collect_set("local_symbol")).cast("long").alias("symbols"), F.sum(F.coalesce("turnover", F.lit(0))).alias("turnover"),
        F.min("_worst").alias("_worst"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap"),
    )
    return tracked.select("isin", "venue", "first_day", "last_day", "days", "symbols", "turnover", F.col("_worst.ratio").alias("worst_ratio"), F.col("_worst.day").alias("worst_ratio_day"), "longest_gap")


def run_counters(instruments: DataFrame, prices: DataFrame, lines: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: how many instruments, price rows, lines and actions a run wrote."""
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((instruments, "instruments"), (prices, "price_rows"), (lines, "lines"), (actions, "actions"))]
    named = [c.select(F.lit(c.columns[0]).alias("name"), F.col(c.columns[0]).alias("n")) for c in counts]
    every = named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])
    return every.agg(*(F.max(F.when(F.col("name") == c.columns[0], F.col("n"))).alias(c.columns[0]) for c in counts))


def survey_json(tracks: DataFrame) -> DataFrame:
    """``isin`` and ``value``: a JSON object of venue to facts for each instrument, decimals as text."""
    facts = [c for c in tracks.columns if c not in ("isin", "venue")]
    text = [F.col(c).cast("string").alias(c) if k.startswith("decimal") else F.col(c) for c, k in tracks.dtypes if c in facts]
    return tracks.groupBy("isin").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("venue", F.struct(*text))))).alias("value"))


def read_survey(lines: DataFrame, like: DataFrame) -> DataFrame:
    """Tracks from the lines of ``survey_json``, with the columns and types of ``like``."""
    kinds = {c: k for c, k in like.dtypes if c not in ("isin", "venue")}
    fields = ", ".join(f"{c}: {'string' if k.startswith('decimal') else k}" for c, k in kinds.items())
    opened = lines.select("isin", F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("venue", "facts"))
    return opened.select("isin", "venue", *(F.col(f"facts.{c}").cast(k).alias(c) for c, k in kinds.items()))


def requirements(tracks: DataFrame, range_end: Column) -> DataFrame:
    """One row an instrument: its liquidity, and whether it meets each requirement."""
    nse = F.col("venue") == "NSE"
    return tracks.groupBy("isin").agg(
        F.sum("turnover").alias("liquidity"),
        F.coalesce(F.bool_or(F.col("worst_ratio") < ACTION_RATIO), F.lit(False)).alias("capital_action"),
        F.bool_or(nse & (F.col("symbols") > 1)).alias("symbol_change"),
        F.bool_and(F.col("last_day") < F.date_sub(range_end, 90)).alias("delisted"),
        F.bool_or((F.col("longest_gap") >= 15) & (F.col("last_day") > F.date_sub(range_end, 60))).alias("suspended"),
        (F.bool_and(F.col("venue") == "BSE")).alias("bse_only"),
        F.bool_and(F.col("first_day") > F.date_sub(range_end, 400)).alias("short_history"),
        (F.bool_and(F.col("venue").isin("BSE", "NSE")) & (F.count_distinct("venue") == 2)).alias("dual_listed"),
    )


def greedy_universe(tracks: DataFrame, range_end: Column, quotas=QUOTAS) -> DataFrame:
    """``isin`` and ``requirement``: for each in turn, the most liquid instruments not yet chosen that meet it.

    An under-filled quota is left so. When a requirement's turn comes, at most the sum of all quotas is chosen, so
    each needs that many candidates and no more: a top-k for each requirement in one pass, a few hundred rows
    whatever the input, from which the driver picks.
    """
    most = sum(n for _, n in quotas)
    met = F.filter(F.array(*(F.when(F.col(name), F.lit(i)) for i, (name, _) in enumerate(quotas))), lambda x: x.isNotNull())
    rows = requirements(tracks, range_end).select("isin", "liquidity", F.explode(met).alias("i"))
    best = rows.withColumn("_at", F.row_number().over(Window.partitionBy("i").orderBy(F.col("liquidity").desc(), "isin"))).where(F.col("_at") <= most)
    candidates = sorted((r.i, r["_at"], r.isin) for r in best.select("i", "_at", "isin").collect())
    chosen: dict[str, str] = {}
    for i, (name, wanted) in enumerate(quotas):
        free = [isin for j, _, isin in candidates if j == i and isin not in chosen]
        chosen |= dict.fromkeys(free[:wanted], name)
    return tracks.sparkSession.createDataFrame(list(chosen.items()), "isin string, requirement string")


def chosen_only(rows: DataFrame, universe: DataFrame) -> DataFrame:
    return rows.join(universe.select("isin"), "isin", "left_semi")
