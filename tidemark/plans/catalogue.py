"""Registered market queries: each a DataFrame plan, and the SQL that an oracle runs on the same tables.

Results carry dates as text and decimals as doubles, so that both sides compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import adjustment, asof, identity, quality, spreads, survey, validation
from tidemark.plans import market, readers, stores
from tidemark.schemas import EQUITY_SERIES, FEW_BARS
from tidemark.sources import files, registry, sinks

AS_OF = "1998-06-15"
REGISTRY = """
[[source]]
source_id = "bars"
tier = 1
base_url = "https://example.org/"
requests_per_second = 0.5
[[source.schema_version]]
version = "old"
effective_from = 1995-01-01
effective_to = 1998-07-05
[[source.schema_version]]
version = "new"
effective_from = 1998-08-01
"""


def plain(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*(F.col(c).cast("string").alias(c) if k == "date" else F.col(c).cast("double").alias(c) if k == "decimal" else F.col(c).cast("long").alias(c) if k in ("integer", "short") else F.col(c) for c, k in kinds.items()))


def _prices(s, d):
    return asof.latest_price(market.price_daily(s, d))


def _deliveries(s, d):
    return asof.latest_delivery(market.delivery_daily(s, d))


def _rounded(df):
    return df.withColumn("factor", F.round("factor", 9))


def _newest():
    return (F.col("o_orderkey").desc(),)


def _listings(s, d):
    return identity.derive_listings(market.observations(s, d), order=("trade_date", "event_id"))


def _daily_observations(s, d):
    """One bar a day of each observed instrument."""
    return market.observations(s, d).groupBy("isin", "venue", "trade_date").agg(F.sum("turnover").alias("turnover"), F.min("local_symbol").alias("local_symbol"))


def _monthly_tracks(s, d):
    bars = _prices(s, d).withColumn("local_symbol", F.concat(F.lit("S"), F.year("trade_date").cast("string")))
    return survey.track_survey(bars, market._versions(s, d).select("venue", "trade_date").distinct())


def _universe_rows(s, d):
    """The tracks of the chosen. They are made once, stored and read again: they are few, what they are made of is not."""
    path = stores.fresh(s, d, "universe_rows")
    _monthly_tracks(s, d).write.parquet(path)
    tracks = s.read.parquet(path)
    return survey.chosen_only(tracks.select("isin", "venue", "days"), survey.greedy_universe(tracks, _range_end(None)))


def _verdicts(s, d):
    latest = _prices(s, d)
    return validation.day_verdicts(latest, validation.typical_bars(latest))


def _series(s, d):
    """Events as file rows: the event's kind and place give a series code of either venue."""
    codes = F.array(*(F.lit(c) for c in ("EQ", "BE", "GB", "TB", "BZ", "N1", "SM")))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.element_at(codes, (F.col("event_id") % 7 + 1).cast("int")).alias("series"))


def _keyed_deliveries(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("venue_key"), F.col("ts").cast("date").alias("trade_date"), F.col("event_id").alias("delivery_quantity"))


def _dimension(s, d):
    return identity.venue_keys(_listings(s, d))


def _versioned_days(s, d):
    days = _prices(s, d).select(F.lit("bars").alias("source_id"), "trade_date").distinct()
    return registry.with_schema_version(days, registry.load_registry(s, REGISTRY)[1])


def _violations(s, d):
    parts = [quality.violations(df, t).select(F.lit(t).alias("table"), "rule", "violations") for t, df in (("price_daily", market.price_daily(s, d)), ("delivery_daily", market.delivery_daily(s, d)), ("corporate_action", market.corporate_action(s, d)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _name_merge(s, d):
    existing = market.instruments(s, d).select("isin", "name", F.lit("old").alias("sector"))
    incoming = market.customer_bars(s, d).groupBy("isin").agg(F.concat(F.lit("N"), F.min("trade_date").cast("string")).alias("name"), F.lit("new").alias("sector"))
    return sinks.merge(existing, incoming, ["isin"], ["name"])


def _insert(s, d):
    existing = market.instruments(s, d)
    return sinks.insert_if_absent(existing, market.customer_bars(s, d).select("isin", F.col("venue").alias("name")).groupBy("isin").agg(F.min("name").alias("name")), ["isin"])


def _spans(s, d):
    """Spans of some three months from each order of a customer, some without an end: many run into the next."""
    days = market.customer_bars(s, d).select("isin", F.col("trade_date").alias("first_day")).distinct()
    return days.withColumn("last_day", F.when(F.day("first_day") != 13, F.date_add("first_day", 90 + F.day("first_day"))))


def _range_end(tracks):
    return F.lit("2001-11-01").cast("date")


PRICE_COLUMNS = "isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, CAST(previous_close AS DOUBLE) AS previous_close, volume, CAST(turnover AS DOUBLE) AS turnover, trade_count"
ACTION_COLUMNS = "isin, action_type, CAST(ex_date AS VARCHAR) AS ex_date, source_id, CAST(as_of_date AS VARCHAR) AS as_of_date, qualifier, CAST(ratio_from AS DOUBLE) AS ratio_from, CAST(ratio_to AS DOUBLE) AS ratio_to, CAST(dividend_amount AS DOUBLE) AS dividend_amount, o_orderkey"
SPREADS = """
spreads AS (
  SELECT *, CAST((400000000 * CAST(abs(bse_close - nse_close) * 10000 AS HUGEINT) + CAST((bse_close + nse_close) * 10000 AS HUGEINT)) // (2 * CAST((bse_close + nse_close) * 10000 AS HUGEINT)) AS DOUBLE) / 10000 AS spread_bps
  FROM (SELECT isin, trade_date, max(as_of_date) AS as_of_date, max(close) FILTER (WHERE venue = 'BSE') AS bse_close, max(close) FILTER (WHERE venue = 'NSE') AS nse_close FROM latest_price GROUP BY ALL)
  WHERE bse_close IS NOT NULL AND nse_close IS NOT NULL)"""
SPREAD_COLUMNS = "isin, CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(bse_close AS DOUBLE) AS bse_close, CAST(nse_close AS DOUBLE) AS nse_close, spread_bps"
SCHEDULE = """
effective AS (
  SELECT isin, ex_date, CAST(ratio_from AS HUGEINT) AS a, CAST(ratio_to AS HUGEINT) AS b FROM corporate_action
  WHERE action_type IN ('split', 'bonus', 'consolidation') AND ratio_from <> 0 AND ratio_to <> 0
  QUALIFY row_number() OVER (PARTITION BY isin, action_type, ex_date ORDER BY as_of_date DESC, o_orderkey DESC) = 1),
daily_ratio AS (SELECT isin, ex_date, list_reduce(list(a), lambda x, y: x * y) AS a, list_reduce(list(b), lambda x, y: x * y) AS b FROM effective GROUP BY ALL),
schedule AS (
  SELECT isin, lag(ex_date) OVER (PARTITION BY isin ORDER BY ex_date) AS valid_from, ex_date,
    list_reduce(list(a) OVER w, lambda x, y: x * y) AS held, list_reduce(list(b) OVER w, lambda x, y: x * y) AS after
  FROM daily_ratio WINDOW w AS (PARTITION BY isin ORDER BY ex_date DESC ROWS UNBOUNDED PRECEDING)),
scaled_bars AS (
  SELECT a.isin, venue, trade_date, close, coalesce(held, 1) AS held, coalesce(after, 1) AS after, CAST(close * 10000 AS HUGEINT) * coalesce(held, 1) AS units
  FROM adjustable a LEFT JOIN schedule s ON a.isin = s.isin AND trade_date < ex_date AND (valid_from IS NULL OR trade_date >= valid_from)),
adjusted AS (
  SELECT isin, venue, trade_date, close, round(CAST(held AS DOUBLE) / CAST(after AS DOUBLE), 9) AS factor,
    units // after + CASE WHEN 2 * (units % after) > after OR (2 * (units % after) = after AND (units // after) % 2 = 1) THEN 1 ELSE 0 END AS adjusted_units
  FROM scaled_bars)"""
SPELLS = """
flagged AS (
  SELECT *, coalesce(scrip_code, '') AS line, CASE WHEN lag(local_symbol) OVER w IS DISTINCT FROM local_symbol THEN 1 ELSE 0 END AS fresh
  FROM observations WINDOW w AS (PARTITION BY isin, venue, coalesce(scrip_code, '') ORDER BY trade_date, event_id)),
numbered AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY isin, venue, line ORDER BY trade_date, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM flagged),
spells AS (SELECT isin, venue, line, run, min(local_symbol) AS symbol, min(scrip_code) AS scrip_code, min(trade_date) AS first_day, max(trade_date) AS last_day FROM numbered GROUP BY ALL),
marked AS (
  SELECT *, row_number() OVER w AS nth, (first_value(symbol) OVER w) = line AND count(*) OVER (PARTITION BY isin, venue, line) > 1 AS bare, lag(first_day) OVER w AS before_day
  FROM spells WINDOW w AS (PARTITION BY isin, venue, line ORDER BY run)),
absorbed AS (SELECT isin, venue, line, run, symbol, scrip_code, CASE WHEN bare AND nth = 2 THEN before_day ELSE first_day END AS first_day, last_day FROM marked WHERE NOT (bare AND nth = 1)),
listings AS (
  SELECT isin, exchange, local_symbol, scrip_code, listing_date, CASE WHEN renamed OR stopped THEN last_day END AS delisting_date, CASE WHEN renamed THEN 'renamed' WHEN stopped THEN 'delisted' END AS closure_reason
  FROM (SELECT a.isin, a.venue AS exchange, symbol AS local_symbol, scrip_code, first_day AS listing_date, last_day, last_day < venue_last - 90 AS stopped,
      lead(run) OVER (PARTITION BY a.isin, a.venue, line ORDER BY run) IS NOT NULL AS renamed
    FROM absorbed a JOIN (SELECT venue, max(trade_date) AS venue_last FROM observations GROUP BY 1) v ON a.venue = v.venue)),
venue_keys AS (
  SELECT exchange, coalesce(scrip_code, local_symbol) AS venue_key, isin FROM listings
  QUALIFY row_number() OVER (PARTITION BY exchange, coalesce(scrip_code, local_symbol) ORDER BY listing_date DESC, isin DESC) = 1)"""
SPELL_COLUMNS = "isin, venue, line, run, symbol, scrip_code, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day"
PRIMARY = """
computed AS (
  SELECT DISTINCT least(CAST(last_day(m) AS DATE), b) AS computed_on
  FROM (SELECT b, unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(date_trunc('month', b) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM (SELECT min(trade_date) AS a, max(trade_date) AS b FROM latest_price))),
trailing_sums AS (
  SELECT isin, venue, computed_on, sum(turnover) AS turnover FROM latest_price JOIN computed ON trade_date > computed_on - 90 AND trade_date <= computed_on GROUP BY ALL),
leaders AS (SELECT * FROM trailing_sums QUALIFY row_number() OVER (PARTITION BY isin, computed_on ORDER BY turnover DESC, venue) = 1),
starts AS (SELECT * FROM (SELECT *, lag(venue) OVER (PARTITION BY isin ORDER BY computed_on) AS before_venue FROM leaders) WHERE before_venue IS DISTINCT FROM venue),
primary_venue AS (SELECT isin, computed_on AS effective_from, computed_on AS as_of_date, lead(computed_on) OVER (PARTITION BY isin ORDER BY computed_on) AS effective_to, venue FROM starts)"""
_FEW = f"printf('{FEW_BARS}', CAST(bars AS VARCHAR), CAST(CAST(floor(0.5 * typical) AS BIGINT) AS VARCHAR))"
DIVERGENT = f"""
divergent AS (
  SELECT * FROM (SELECT isin, trade_date, (max(CAST(close AS DOUBLE)) - min(CAST(close AS DOUBLE))) / (CAST(sum(close) AS DOUBLE) / count(close)) * 10000.0 AS bps, count(DISTINCT venue) AS venues FROM latest_price GROUP BY isin, trade_date)
  WHERE venues >= 2 AND bps > 500),
daily_bars AS (SELECT venue, trade_date, count(*) AS bars FROM latest_price GROUP BY ALL),
typical AS (SELECT venue, bars AS typical FROM daily_bars QUALIFY row_number() OVER (PARTITION BY venue ORDER BY bars, trade_date) = count(*) OVER (PARTITION BY venue) // 2 + 1),
verdicts AS (
  SELECT b.venue, b.trade_date, bars, coalesce(n, 0) AS divergent_instruments,
    nullif(concat_ws('; ', CASE WHEN bars < floor(0.5 * typical) THEN {_FEW} END, CASE WHEN n > 0 THEN {readers.APART_SQL} END), '') AS detail
  FROM daily_bars b LEFT JOIN typical t ON b.venue = t.venue LEFT JOIN (SELECT trade_date, count(*) AS n, max(bps) AS worst FROM divergent GROUP BY 1) w ON b.trade_date = w.trade_date)"""
TRACKS = """
named AS (SELECT *, 'S' || year(trade_date) AS local_symbol FROM latest_price),
day_no AS (SELECT venue, trade_date, row_number() OVER (PARTITION BY venue ORDER BY trade_date) AS no FROM (SELECT DISTINCT venue, trade_date FROM latest_price)),
gaps AS (
  SELECT isin, venue, CAST(coalesce(max(gap), 0) AS BIGINT) AS longest_gap
  FROM (SELECT p.isin, p.venue, greatest(no - lag(no) OVER (PARTITION BY p.isin, p.venue ORDER BY p.trade_date) - 1, 0) AS gap FROM latest_price p JOIN day_no n ON p.venue = n.venue AND p.trade_date = n.trade_date) GROUP BY ALL),
worst AS (
  SELECT isin, venue, CAST(close AS DOUBLE) / CAST(previous_close AS DOUBLE) AS worst_ratio, trade_date AS worst_ratio_day FROM latest_price WHERE previous_close > 0
  QUALIFY row_number() OVER (PARTITION BY isin, venue ORDER BY CAST(close AS DOUBLE) / CAST(previous_close AS DOUBLE), trade_date) = 1),
tracks AS (
  SELECT t.*, worst_ratio, worst_ratio_day, longest_gap
  FROM (SELECT isin, venue, min(trade_date) AS first_day, max(trade_date) AS last_day, count(*) AS days, count(DISTINCT local_symbol) AS symbols, sum(turnover) AS turnover FROM named GROUP BY ALL) t
  LEFT JOIN worst w ON t.isin = w.isin AND t.venue = w.venue JOIN gaps g ON t.isin = g.isin AND t.venue = g.venue),
needs AS (
  SELECT isin, sum(turnover) AS liquidity, coalesce(bool_or(worst_ratio < 0.7), false) AS capital_action, bool_or(venue = 'NSE' AND symbols > 1) AS symbol_change, bool_and(last_day < DATE '2001-11-01' - 90) AS delisted,
    bool_or(longest_gap >= 15 AND last_day > DATE '2001-11-01' - 60) AS suspended, bool_and(venue = 'BSE') AS bse_only, bool_and(first_day > DATE '2001-11-01' - 400) AS short_history, count(DISTINCT venue) = 2 AS dual_listed
  FROM tracks GROUP BY isin)"""


def _greedy_sql() -> str:
    parts, before = [], []
    for i, (name, n) in enumerate(survey.QUOTAS):
        left = " AND ".join(["true", *(f"isin NOT IN (SELECT isin FROM pick{j})" for j in range(i))])
        parts.append(f"pick{i} AS MATERIALIZED (SELECT isin, '{name}' AS requirement FROM needs WHERE {name} AND {left} ORDER BY liquidity DESC, isin LIMIT {n})")
        before.append(f"SELECT * FROM pick{i}")
    return ",\n".join([TRACKS, *parts]), " UNION ALL ".join(before)


def _rules_sql() -> str:
    checks = {
        "price_daily": {"high_over_low": "high >= low", "high_over_open": "high >= open", "low_under_open": "low <= open", "prices_not_negative": "open >= 0 AND high >= 0 AND low >= 0 AND close >= 0", "volume_not_negative": "volume >= 0", "known_after_trade": "as_of_date >= trade_date"},
        "delivery_daily": {"delivery_not_negative": "delivery_quantity >= 0"},
        "corporate_action": {
            "type_known": "action_type IN ('split', 'bonus', 'consolidation', 'rights', 'dividend')", "amount_iff_dividend": "(action_type = 'dividend') = (dividend_amount IS NOT NULL)",
            "ratio_iff_not_dividend": "(action_type <> 'dividend') = (ratio_from IS NOT NULL)", "ratio_whole": "(ratio_from IS NULL) = (ratio_to IS NULL)", "ratio_positive": "ratio_from > 0 AND ratio_to > 0",
        },
    }
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({c}, true)) AS violations FROM {t}" for t, rules in checks.items() for n, c in rules.items())


#: Name to (plan, extra common table expressions, select).
_ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str, str]] = {
    "latest_price": (_prices, "", f"SELECT {PRICE_COLUMNS} FROM latest_price"),
    "latest_price_asof": (
        lambda s, d: asof.latest_price(market.price_daily(s, d), AS_OF), "",
        f"SELECT {PRICE_COLUMNS} FROM (SELECT * FROM price_daily WHERE as_of_date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY isin, venue, trade_date ORDER BY as_of_date DESC) = 1)"),
    "latest_delivery": (_deliveries, "", "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of_date AS VARCHAR) AS as_of_date, delivery_quantity FROM latest_delivery"),
    "latest_action": (
        lambda s, d: asof.latest_action(market.corporate_action(s, d), None, _newest()), "",
        f"SELECT {ACTION_COLUMNS}, CAST((2000000 * CAST(ratio_from AS HUGEINT) + CAST(ratio_to AS HUGEINT)) // (2 * CAST(ratio_to AS HUGEINT)) AS DOUBLE) / 1000000 AS adjustment_factor FROM corporate_action QUALIFY row_number() OVER (PARTITION BY isin, action_type, ex_date, qualifier, source_id ORDER BY as_of_date DESC, o_orderkey DESC) = 1"),
    "latest_verdict": (
        lambda s, d: asof.latest_verdict(_verdicts(s, d).unionByName(_verdicts(s, d).withColumns({"as_of_date": F.date_add("as_of_date", 1), "bars": (F.col("bars") + 1).cast("int")}))).select("venue", "trade_date", "as_of_date", "bars"), DIVERGENT,
        "SELECT venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(trade_date + 1 AS VARCHAR) AS as_of_date, bars + 1 AS bars FROM verdicts"),
    "venue_spread": (lambda s, d: spreads.venue_spread(_prices(s, d)), SPREADS, f"SELECT {SPREAD_COLUMNS} FROM spreads"),
    "venue_spread_wide": (lambda s, d: quality.wide_spreads(spreads.venue_spread(_prices(s, d))), SPREADS, f"SELECT {SPREAD_COLUMNS} FROM spreads WHERE spread_bps > 500"),
    "complete_days_spread": (
        lambda s, d: spreads.venue_spread(asof.complete_days_only(_prices(s, d), validation.day_verdicts(_prices(s, d), validation.typical_bars(_prices(s, d)), 1e9))), DIVERGENT + "," + SPREADS.replace("FROM latest_price", "FROM (SELECT p.* FROM latest_price p SEMI JOIN (SELECT b.venue, b.trade_date FROM daily_bars b JOIN typical t ON b.venue = t.venue WHERE bars >= floor(0.5 * typical)) c ON p.venue = c.venue AND p.trade_date = c.trade_date)"),
        f"SELECT {SPREAD_COLUMNS} FROM spreads"),
    "delivery_participation": (
        lambda s, d: spreads.delivery_participation(_prices(s, d), _deliveries(s, d)), "",
        "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(greatest(p.as_of_date, q.as_of_date) AS VARCHAR) AS as_of_date, volume, delivery_quantity, CAST((2000000 * CAST(delivery_quantity AS HUGEINT) + volume) // nullif(2 * volume, 0) AS DOUBLE) / 10000 AS delivery_pct FROM latest_price p JOIN latest_delivery q USING (isin, venue, trade_date)"),
    "delivery_over_volume": (lambda s, d: quality.delivery_over_volume(_prices(s, d), _deliveries(s, d)), "", "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, volume, delivery_quantity FROM latest_price JOIN latest_delivery USING (isin, venue, trade_date) WHERE delivery_quantity > volume"),
    "factor_schedule": (
        lambda s, d: adjustment.factor_schedule(market.corporate_action(s, d), _newest()).withColumns({c: F.col(c).cast("string") for c in ("held", "after")}).drop("factor"), SCHEDULE,
        "SELECT isin, CAST(valid_from AS VARCHAR) AS valid_from, CAST(ex_date AS VARCHAR) AS ex_date, CAST(held AS VARCHAR) AS held, CAST(after AS VARCHAR) AS after FROM schedule"),
    "adjusted_close": (
        lambda s, d: _rounded(adjustment.adjust(market.adjustable_bars(s, d), market.corporate_action(s, d), _newest())), SCHEDULE,
        "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close, factor, CAST(adjusted_units AS DOUBLE) / 10000 AS adjusted_close FROM adjusted"),
    "adjusted_close_asof": (
        lambda s, d: _rounded(adjustment.adjust(market.adjustable_bars(s, d), asof.known_as_of(market.corporate_action(s, d), AS_OF), _newest())), SCHEDULE.replace("FROM corporate_action", f"FROM (SELECT * FROM corporate_action WHERE as_of_date <= DATE '{AS_OF}')"),
        "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close, factor, CAST(adjusted_units AS DOUBLE) / 10000 AS adjusted_close FROM adjusted"),
    "step_closure": (
        lambda s, d: adjustment.step_closure(market.adjustable_bars(s, d), market.corporate_action(s, d), _newest()), SCHEDULE,
        """SELECT x.isin, CAST(x.ex_date AS VARCHAR) AS ex_date, b.venue, CAST(b.trade_date AS VARCHAR) AS before_day, CAST(b.close AS DOUBLE) AS before_close, CAST(b.adjusted_units AS DOUBLE) / 10000 AS adjusted_before,
  CAST(n.trade_date AS VARCHAR) AS on_day, CAST(n.close AS DOUBLE) AS on_close,
  CAST((2000000 * CAST(b.close * 10000 AS HUGEINT) + CAST(n.close * 10000 AS HUGEINT)) // (2 * CAST(n.close * 10000 AS HUGEINT)) AS DOUBLE) / 1000000 AS raw_step,
  CAST((2000000 * CAST(b.adjusted_units AS HUGEINT) + CAST(n.close * 10000 AS HUGEINT)) // (2 * CAST(n.close * 10000 AS HUGEINT)) AS DOUBLE) / 1000000 AS adjusted_step
FROM schedule x ASOF JOIN adjusted b ON x.isin = b.isin AND x.ex_date > b.trade_date ASOF JOIN adjusted n ON x.isin = n.isin AND x.ex_date <= n.trade_date"""),
    "listing_spells": (lambda s, d: identity.listing_spells(market.observations(s, d), ("trade_date", "event_id")), SPELLS, f"SELECT {SPELL_COLUMNS} FROM spells"),
    "absorbed_spells": (lambda s, d: identity.absorb_untickered(identity.listing_spells(market.observations(s, d), ("trade_date", "event_id"))), SPELLS, f"SELECT {SPELL_COLUMNS} FROM absorbed"),
    "listing_closure": (_listings, SPELLS, "SELECT isin, exchange, local_symbol, scrip_code, CAST(listing_date AS VARCHAR) AS listing_date, CAST(delisting_date AS VARCHAR) AS delisting_date, closure_reason FROM listings"),
    "symbol_in_force": (
        lambda s, d: identity.in_force(_daily_observations(s, d).select("isin", "venue", "trade_date"), _listings(s, d)), SPELLS,
        "SELECT o.isin, o.venue, CAST(trade_date AS VARCHAR) AS trade_date, l.local_symbol AS listed_symbol, CAST(listing_date AS VARCHAR) AS listing_date, CAST(delisting_date AS VARCHAR) AS delisting_date FROM (SELECT DISTINCT isin, venue, trade_date FROM observations) o JOIN listings l ON o.isin = l.isin AND o.venue = l.exchange AND trade_date >= listing_date AND (delisting_date IS NULL OR trade_date <= delisting_date)"),
    "span_overlaps": (
        lambda s, d: identity.overlaps(_spans(s, d), ["isin"], "first_day", "last_day"), "",
        "SELECT isin, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, CAST(next_start AS VARCHAR) AS next_start FROM (SELECT *, lead(first_day) OVER (PARTITION BY isin ORDER BY first_day, last_day NULLS LAST) AS next_start FROM (SELECT isin, trade_date AS first_day, CASE WHEN day(trade_date) <> 13 THEN trade_date + CAST(90 + day(trade_date) AS INTEGER) END AS last_day FROM (SELECT DISTINCT isin, trade_date FROM customer_bars))) WHERE next_start IS NOT NULL AND (last_day IS NULL OR last_day > next_start)"),
    "primary_venue": (lambda s, d: identity.derive_primary_venue(_prices(s, d)), PRIMARY, "SELECT isin, CAST(effective_from AS VARCHAR) AS effective_from, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(effective_to AS VARCHAR) AS effective_to, venue FROM primary_venue"),
    "trailing_turnover": (lambda s, d: identity.trailing_turnover(_prices(s, d)), PRIMARY, "SELECT isin, venue, CAST(computed_on AS VARCHAR) AS computed_on, CAST(turnover AS DOUBLE) AS turnover FROM trailing_sums"),
    "divergences": (lambda s, d: validation.divergences(_prices(s, d)).withColumn("bps", F.floor(F.col("bps") * 1e4 + 0.5) / 1e4), DIVERGENT, "SELECT isin, CAST(trade_date AS VARCHAR) AS trade_date, floor(bps * 1e4 + 0.5) / 1e4 AS bps FROM divergent"),
    "typical_bars": (lambda s, d: validation.typical_bars(_prices(s, d)), DIVERGENT, "SELECT venue, typical FROM typical"),
    "day_verdicts": (_verdicts, DIVERGENT, "SELECT venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(trade_date AS VARCHAR) AS as_of_date, detail IS NULL AS is_complete, bars, divergent_instruments, detail FROM verdicts"),
    "equity_filter": (lambda s, d: files.equity_only(_series(s, d), "NSE"), "", "SELECT * FROM (SELECT event_id, user_id, list_extract(['EQ', 'BE', 'GB', 'TB', 'BZ', 'N1', 'SM'], CAST(event_id % 7 + 1 AS INTEGER)) AS series FROM events) WHERE series IN " + str(EQUITY_SERIES["NSE"])),
    "series_skipped": (lambda s, d: files.skipped_series(_series(s, d), "NSE"), "", "SELECT series, count(*) AS n FROM (SELECT list_extract(['EQ', 'BE', 'GB', 'TB', 'BZ', 'N1', 'SM'], CAST(event_id % 7 + 1 AS INTEGER)) AS series FROM events) WHERE series NOT IN " + str(EQUITY_SERIES["NSE"]) + " GROUP BY 1"),
    "key_resolution": (lambda s, d: identity.resolve_keys(_keyed_deliveries(s, d), _dimension(s, d), "BSE")[0], SPELLS, "SELECT k.venue_key, CAST(trade_date AS VARCHAR) AS trade_date, delivery_quantity, isin FROM (SELECT CAST(user_id AS VARCHAR) AS venue_key, CAST(ts AS DATE) AS trade_date, event_id AS delivery_quantity FROM events) k JOIN venue_keys v ON k.venue_key = v.venue_key AND exchange = 'BSE'"),
    "unresolved_keys": (lambda s, d: identity.resolve_keys(_keyed_deliveries(s, d), _dimension(s, d), "BSE")[1], SPELLS, "SELECT DISTINCT CAST(user_id AS VARCHAR) AS venue_key FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT venue_key FROM venue_keys WHERE exchange = 'BSE')"),
    "schema_version_for_day": (_versioned_days, "", "SELECT 'bars' AS source_id, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN trade_date BETWEEN DATE '1995-01-01' AND DATE '1998-07-05' THEN 'old' WHEN trade_date >= DATE '1998-08-01' THEN 'new' END AS version FROM (SELECT DISTINCT trade_date FROM latest_price)"),
    "orphans": (lambda s, d: quality.orphans(market.customer_bars(s, d), market.instruments(s, d), "isin", "isin").groupBy("isin").agg(F.count("*").alias("n")), "", "SELECT isin, count(*) AS n FROM customer_bars WHERE isin NOT IN (SELECT isin FROM instruments) GROUP BY 1"),
    "duplicates": (lambda s, d: quality.duplicates(market.price_daily(s, d), "isin", "venue", "trade_date"), "", "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS n FROM price_daily GROUP BY isin, venue, price_daily.trade_date HAVING count(*) > 1"),
    "integrity_violations": (_violations, "", _rules_sql()),
    "dual_listed_divergent": (
        lambda s, d: _prices(s, d).groupBy("isin", "trade_date").agg(F.count_distinct("venue").alias("venues"), F.min("close").alias("low"), F.max("close").alias("high")).where("venues = 2 AND low <> high"), "",
        "SELECT isin, CAST(trade_date AS VARCHAR) AS trade_date, count(DISTINCT venue) AS venues, CAST(min(close) AS DOUBLE) AS low, CAST(max(close) AS DOUBLE) AS high FROM latest_price GROUP BY isin, latest_price.trade_date HAVING count(DISTINCT venue) = 2 AND min(close) <> max(close)"),
    "single_venue": (lambda s, d: _daily_observations(s, d).groupBy("isin").agg(F.count_distinct("venue").alias("venues"), F.min("venue").alias("venue")).where("venues = 1 AND venue = 'BSE'"), "", "SELECT isin, count(DISTINCT venue) AS venues, min(venue) AS venue FROM observations GROUP BY 1 HAVING count(DISTINCT venue) = 1 AND min(venue) = 'BSE'"),
    "renamed": (lambda s, d: market.observations(s, d).groupBy("isin").agg(F.count_distinct("local_symbol").alias("symbols")).where("symbols > 1"), "", "SELECT isin, count(DISTINCT local_symbol) AS symbols FROM observations GROUP BY 1 HAVING count(DISTINCT local_symbol) > 1"),
    "worst_ratio": (lambda s, d: survey.worst_ratios(_prices(s, d)), TRACKS, "SELECT isin, venue, worst_ratio, CAST(worst_ratio_day AS VARCHAR) AS worst_ratio_day FROM worst"),
    "history_start_spread": (
        lambda s, d: _prices(s, d).groupBy("isin").agg(F.min("trade_date").alias("first")).agg(F.datediff(F.max("first"), F.min("first")).alias("days"), F.min("first").alias("earliest"), F.max("first").alias("latest"), F.count("*").alias("instruments")), "",
        "SELECT max(f) - min(f) AS days, CAST(min(f) AS VARCHAR) AS earliest, CAST(max(f) AS VARCHAR) AS latest, count(*) AS instruments FROM (SELECT isin, min(trade_date) AS f FROM latest_price GROUP BY 1)"),
    "longest_calendar_gap": (lambda s, d: survey.calendar_gaps(_prices(s, d)), "", "SELECT isin, venue, max(gap) AS gap FROM (SELECT isin, venue, trade_date - lag(trade_date) OVER (PARTITION BY isin, venue ORDER BY trade_date) AS gap FROM latest_price) GROUP BY ALL"),
    "longest_trading_gap": (lambda s, d: survey.trading_gaps(_prices(s, d)), TRACKS, "SELECT isin, venue, longest_gap FROM gaps"),
    "holidays": (
        lambda s, d: survey.holidays(_prices(s, d)), "",
        "SELECT CAST(d AS VARCHAR) AS trade_date FROM (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT min(trade_date) AS a, max(trade_date) AS b FROM latest_price)) WHERE isodow(d) <= 5 AND d NOT IN (SELECT trade_date FROM latest_price)"),
    "track_survey": (_monthly_tracks, TRACKS, "SELECT isin, venue, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, days, symbols, CAST(turnover AS DOUBLE) AS turnover, worst_ratio, CAST(worst_ratio_day AS VARCHAR) AS worst_ratio_day, longest_gap FROM tracks"),
    "greedy_universe": (lambda s, d: survey.greedy_universe(_monthly_tracks(s, d), _range_end(None)), *_greedy_sql()),
    "universe_rows": (_universe_rows, _greedy_sql()[0], f"SELECT isin, venue, days FROM tracks WHERE isin IN (SELECT isin FROM ({_greedy_sql()[1]}))"),
    "dominant_line": (
        lambda s, d: identity.dominant_line(market.observations(s, d).select("isin", "venue", F.col("local_symbol").alias("line"), "turnover")), "",
        "SELECT isin, venue, line, CAST(turnover AS DOUBLE) AS turnover FROM (SELECT isin, venue, local_symbol AS line, sum(turnover) AS turnover FROM observations GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY isin, venue ORDER BY turnover DESC, line) = 1"),
    "instrument_rows": (lambda s, d: identity.derive_instruments(market.customer_bars(s, d), market.instruments(s, d)).drop("sector"), "", "SELECT p.isin, coalesce(name, p.isin) AS name, 'IN' AS country, 'equity' AS instrument_type FROM (SELECT DISTINCT isin FROM customer_bars) p LEFT JOIN instruments i ON p.isin = i.isin"),
    "venue_last_day": (lambda s, d: identity.last_days(market.observations(s, d)), "", "SELECT venue, CAST(max(trade_date) AS VARCHAR) AS venue_last_day FROM observations GROUP BY 1"),
    "last_bar_before": (
        lambda s, d: asof.first_of_group(_prices(s, d).where(f"trade_date < DATE '{AS_OF}'"), ["isin", "venue"], F.col("trade_date").desc()).select("isin", "venue", "trade_date", "close"), "",
        f"SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close FROM latest_price WHERE trade_date < DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY isin, venue ORDER BY latest_price.trade_date DESC) = 1"),
    "dual_listed": (lambda s, d: _prices(s, d).where("venue = 'BSE'").select("isin").intersect(_prices(s, d).where("venue = 'NSE'").select("isin")), "", "SELECT isin FROM latest_price WHERE venue = 'BSE' INTERSECT SELECT isin FROM latest_price WHERE venue = 'NSE'"),
    "dataset_span": (
        lambda s, d: _prices(s, d).agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count_distinct("trade_date").alias("days"), F.count_distinct("isin").alias("instruments"), F.count("*").alias("bars")), "",
        "SELECT CAST(min(trade_date) AS VARCHAR) AS first_day, CAST(max(trade_date) AS VARCHAR) AS last_day, count(DISTINCT trade_date) AS days, count(DISTINCT isin) AS instruments, count(*) AS bars FROM latest_price"),
    "upsert_merge": (_name_merge, "", "SELECT coalesce(e.isin, n.isin) AS isin, coalesce(n.name, e.name) AS name, CASE WHEN e.isin IS NULL THEN 'new' ELSE 'old' END AS sector FROM instruments e FULL JOIN (SELECT isin, 'N' || CAST(min(trade_date) AS VARCHAR) AS name FROM customer_bars GROUP BY 1) n ON e.isin = n.isin"),
    "insert_if_absent": (_insert, "", "SELECT isin, name FROM instruments UNION ALL SELECT isin, min(venue) FROM customer_bars WHERE isin NOT IN (SELECT isin FROM instruments) GROUP BY 1"),
}


_ENTRIES |= readers.entries(DIVERGENT, PRIMARY, TRACKS) | stores.entries(PRICE_COLUMNS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def made(plan):
        return lambda spark, sf_dir: plain(plan(spark, sf_dir))

    return {name: made(entry[0]) for name, entry in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: "WITH " + ",\n".join(x.strip() for x in (market.SQL, extra) if x) + "\n" + select for name, (_, extra, select) in _ENTRIES.items()}
