"""Registered queries of the readers, writers and views: raw text made from the test tables, and SQL for what must come of it."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import asof, identity, quality, survey, validation
from tidemark.plans import market, views
from tidemark.schemas import APART, COUNT_CHANGING, EQUITY_SERIES, MISDATED
from tidemark.sources import files, registry, sinks

SERIES = ("A", "EQ", "G", "B", "BE", "X", "GB")
REPORTED = "2024-09-01"


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _pick(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _text(s: SparkSession, d: str) -> DataFrame:
    """Line items as the text fields that files carry."""
    price, n = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_linenumber")
    blank = lambda c, when: F.when(when, F.lit("  ")).otherwise(c.cast("string"))
    return _table(s, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("day"), F.col("l_partkey").cast("string").alias("code"), market.isin(F.col("l_suppkey")).alias("isin"), F.concat(F.lit("T"), "l_suppkey").alias("symbol"),
        _pick(SERIES, n + F.col("l_partkey")).alias("series"), F.concat(F.lit(" Name "), "l_suppkey", F.lit("  ")).alias("name"), price.cast("string").alias("open"), (price + 1).cast("string").alias("high"),
        (price - 1).cast("string").alias("low"), price.cast("string").alias("close"), blank(price, n % 3 == 0).alias("previous_close"), F.col("l_quantity").cast("long").cast("string").alias("volume"),
        blank(price * 2, n % 4 == 0).alias("turnover"), blank(n, n % 5 == 0).alias("trade_count"),
    )


def _raw(s: SparkSession, d: str, columns: dict[str, str], day: Column, **padded: Column) -> DataFrame:
    names = {"instrument_id": "code"}
    own = _text(s, d).withColumn("trade_date", day)
    return own.select(*(padded.get(c, F.col(names.get(c, c))).alias(header) for c, header in columns.items()), F.lit("unused").alias("Remarks"))


def _udiff(s, d):
    return _raw(s, d, files.UDIFF, F.date_format("day", "yyyy-MM-dd"))


def _bse_legacy(s, d):
    pad = lambda c: F.rpad(c, 12, " ")
    return _raw(s, d, files.BSE_LEGACY, F.date_format("day", "dd-MMM-yy"), series=pad("series"), instrument_id=pad("code"), isin=F.concat("isin", F.lit(" ")))


def _nse_legacy(s, d):
    return _raw(s, d, files.NSE_LEGACY, F.upper(F.date_format("day", "dd-MMM-yyyy")))


def _shown(bars: DataFrame) -> DataFrame:
    """Counts that may be null as text, so that both sides compare alike."""
    return bars.withColumn("trade_count", F.col("trade_count").cast("string"))


def _all_bars(s, d):
    return files.concatenate(*(files.read_rows(raw(s, d), venue, version) for raw, venue, version in ((_bse_legacy, "BSE", "legacy"), (_nse_legacy, "NSE", "legacy"), (_udiff, "BSE", "udiff"))))


def _bars_sql(venue: str, symbol: str, code: str) -> str:
    return (
        f"SELECT isin, '{venue}' AS venue, CAST(day AS VARCHAR) AS trade_date, CAST(day AS VARCHAR) AS as_of_date, {symbol} AS local_symbol, {code} AS scrip_code, CAST(p AS DOUBLE) AS open, CAST(p + 1 AS DOUBLE) AS high, CAST(p - 1 AS DOUBLE) AS low, CAST(p AS DOUBLE) AS close, "
        f"CASE WHEN n % 3 <> 0 THEN CAST(p AS DOUBLE) END AS previous_close, volume, CASE WHEN n % 4 <> 0 THEN CAST(p * 2 AS DOUBLE) END AS turnover, CASE WHEN n % 5 <> 0 THEN CAST(n AS VARCHAR) END AS trade_count FROM file_rows WHERE series IN {EQUITY_SERIES[venue]}"
    )


FILE_ROWS = f"""
file_rows AS (
  SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_partkey AS VARCHAR) AS code, 'IN' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '0' AS isin, 'T' || l_suppkey AS symbol, list_extract({list(SERIES)}, CAST((l_linenumber + l_partkey) % 7 + 1 AS INTEGER)) AS series,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_quantity AS BIGINT) AS volume, l_linenumber AS n
  FROM lineitem)"""


def _bars_by_version(s, d):
    """Each day's rows in the format of its schema version; days without one are left to ``unmapped``."""
    spans = registry.load_registry(s, VERSIONS)[1]
    days = registry.with_schema_version(_text(s, d).select(F.lit("bse").alias("source_id"), F.col("day").alias("trade_date")).distinct(), spans)
    in_version = lambda v: days.where(F.col("version") == v).select("trade_date")
    parts = [files.read_rows(raw(s, d), "BSE", v).join(in_version(v), "trade_date", "left_semi") for v, raw in (("legacy", _bse_legacy), ("udiff", _udiff))]
    return _shown(files.concatenate(*parts))


VERSIONS = """
[[source]]
source_id = "bse"
tier = 1
base_url = "https://example.org/"
requests_per_second = 0.5
[[source.schema_version]]
version = "legacy"
effective_from = 1990-01-01
effective_to = 1997-12-31
[[source.schema_version]]
version = "udiff"
effective_from = 1998-02-01
"""


def _nse_delivery(s, d):
    rows = _text(s, d)
    pad = lambda c: F.concat(F.lit(" "), c)
    return rows.select(F.col("symbol").alias("SYMBOL"), pad("series").alias(" SERIES"), pad(F.date_format("day", "dd-MMM-yyyy")).alias(" DATE1"), pad("volume").alias(" TTL_TRD_QNTY"), pad(F.when(F.col("series") == "GB", "-").otherwise(F.col("volume"))).alias(" DELIV_QTY"))


def _bse_delivery(s, d):
    rows = _text(s, d)
    line = F.concat_ws("|", F.date_format("day", "ddMMyyyy"), F.lpad("code", 9, "0"), F.lpad("volume", 12, "0"), F.lit("x"))
    return rows.select(F.when(F.col("series") == "X", "").when(F.col("series") == "G", F.concat_ws("|", F.lit("short"), "code")).otherwise(line).alias("value"))


def _payloads(s, d):
    """A customer's orders as one payload of announcements."""
    k = F.col("o_orderkey")
    n = lambda m: (k % m + 1).cast("string")
    texts = [F.concat(F.lit(" Bonus  issue "), n(3), F.lit(":"), n(2), F.lit(" ")), F.concat(F.lit("Stock  Split From Rs.10/- to Rs."), _pick(("2", "5", "20"), k), F.lit("/-")), F.concat(F.lit("Interim Dividend - Rs. - "), n(9), F.lit(".5000")),
             F.concat(F.lit("FINAL dividend - Rs. - "), n(4)), F.lit("Scheme of Arrangement"), F.concat(F.lit("Some Special Dividend - Rs. - "), n(5)), F.concat(F.lit("Stock Split From Rs 3 to Rs "), n(7))]
    record = F.struct("o_orderkey", F.col("o_custkey").alias("scrip_code"), F.element_at(F.array(*texts), (k % 7 + 1).cast("int")).alias("Purpose"), F.date_format(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), "yyyyMMdd").alias("exdate"), F.lit("spare").alias("extra"))
    held = _table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(record)).alias("r"))
    return held.select(F.to_json(F.transform("r", lambda x: F.struct(x["scrip_code"].alias("scrip_code"), x["Purpose"].alias("Purpose"), x["exdate"].alias("exdate"), x["extra"].alias("extra")))).alias("value"))


def _customer_listings(s, d):
    key = F.col("c_custkey")
    venue = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "NSE").otherwise("BSE")
    return _table(s, d, "customer").select(
        market.isin(key).alias("isin"), venue.alias("exchange"), F.concat(F.lit("C"), key).alias("local_symbol"), F.when(venue == "BSE", key.cast("string")).alias("scrip_code"), F.lit("1995-01-02").cast("date").alias("listing_date"),
        F.when(F.col("c_acctbal") < 0, F.lit("1998-03-04").cast("date")).alias("delisting_date"), F.when(F.col("c_acctbal") < 0, "delisted").alias("closure_reason"),
    )


def _actions(s, d):
    return files.normalize_actions(files.parse_actions(_payloads(s, d)), files.bse_scrips(_customer_listings(s, d)), REPORTED, "bse_actions")


ANNOUNCED = """
announced AS (
  SELECT o_custkey, o_orderkey AS k, o_orderkey % 7 AS form, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ex_date, 'IN' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '0' AS isin, o_orderkey % 7 + 1 AS face, list_extract([2, 5, 20], CAST(o_orderkey % 3 + 1 AS INTEGER)) AS part
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD'),
terms AS (
  SELECT *, CASE WHEN form = 0 THEN 'bonus' WHEN form = 1 THEN CASE WHEN part > 10 THEN 'consolidation' ELSE 'split' END WHEN form = 6 THEN CASE WHEN face > 3 THEN 'consolidation' ELSE 'split' END WHEN form = 4 THEN 'unhandled' ELSE 'dividend' END AS action_type,
    CASE form WHEN 2 THEN 'interim' WHEN 3 THEN 'final' ELSE 'ordinary' END AS qualifier,
    CASE WHEN form = 0 THEN CAST(k % 2 + 1 AS DOUBLE) WHEN form = 1 THEN CASE WHEN part > 10 THEN part / 10.0 ELSE 1.0 END WHEN form = 6 THEN CASE WHEN face > 3 THEN round(face / 3.0, 6) ELSE 1.0 END END AS ratio_from,
    CASE WHEN form = 0 THEN CAST(k % 3 + k % 2 + 2 AS DOUBLE) WHEN form = 1 THEN CASE WHEN part > 10 THEN 1.0 ELSE 10.0 / part END WHEN form = 6 THEN CASE WHEN face > 3 THEN 1.0 ELSE round(3.0 / face, 6) END END AS ratio_to,
    CASE form WHEN 2 THEN k % 9 + 1.5 WHEN 3 THEN k % 4 + 1.0 WHEN 5 THEN k % 5 + 1.0 END AS dividend_amount
  FROM announced)"""
CUSTOMER_LISTINGS = """
customer_listings AS (
  SELECT 'IN' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '0' AS isin, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'NSE' ELSE 'BSE' END AS exchange, 'C' || c_custkey AS local_symbol, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(c_custkey AS VARCHAR) END AS scrip_code,
    DATE '1995-01-02' AS listing_date, CASE WHEN c_acctbal < 0 THEN DATE '1998-03-04' END AS delisting_date, CASE WHEN c_acctbal < 0 THEN 'delisted' END AS closure_reason
  FROM customer)"""
LISTING_TEXT = "isin, exchange, local_symbol, scrip_code, CAST(listing_date AS VARCHAR) AS listing_date, CAST(delisting_date AS VARCHAR) AS delisting_date, closure_reason"


def _archives(s, d):
    """A zip a nation; some are no archive, some hold two entries."""

    def packed(batches):
        for batch in batches:
            out = []
            for name, region in zip(batch["n_name"], batch["n_regionkey"]):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for i in range(2 if region == 1 else 1):
                        z.writestr(f"{name}{i}.CSV", f"name,region\r\n{name},{region}\r\n")
                out.append((name, b"no archive" if region == 0 else data.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    opened = files.unzip_each(_table(s, d, "nation").select("n_name", "n_regionkey").mapInPandas(packed, "path string, content binary"), ".csv")
    lines = files.lines_of(opened.where("error IS NULL").select("path", "content"))
    rows = files.csv_of(lines, "name,region").select(F.col("name").alias("path"), F.col("region"), F.lit(False).alias("failed"))
    return rows.unionByName(opened.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("region"), F.lit(True).alias("failed")))


def _landed(s, d):
    """Pages as landed files; some come after text, some after white space."""
    head = F.when(F.length("url") % 3 == 0, F.col("url")).when(F.length("url") % 3 == 1, F.lit(" \n\t")).otherwise(F.lit(""))
    content = F.concat(head, F.coalesce("html", F.lit(""))).cast("binary")
    return files.not_error_pages(_table(s, d, "pages").select("page_id", content.alias("content"))).select("page_id")


def _unresolvable(s, d):
    bad = identity.unresolvable(_table(s, d, "part").select(F.when(F.col("p_size") > 25, market.isin(F.col("p_partkey"))).when(F.col("p_size") > 3, F.col("p_brand")).alias("isin")))
    return bad.groupBy("isin").agg(F.count("*").alias("n"))


def _price(s, d):
    return asof.latest_price(market.price_daily(s, d))


def _days(s, d):
    latest = _price(s, d)
    return validation.day_verdicts(latest, validation.typical_bars(latest))


def _lines(table):
    return lambda s, d: sinks.csv_lines(_facts(s, d)[table](), table)


def _facts(s, d):
    return {
        "price_daily": lambda: market.price_daily(s, d), "delivery_daily": lambda: market.delivery_daily(s, d), "corporate_action": lambda: market.corporate_action(s, d), "listing": lambda: _customer_listings(s, d), "trading_day": lambda: _days(s, d),
        "instrument_master": lambda: identity.derive_instruments(_price(s, d), market.instruments(s, d)),
    }


def _view(sql: str, as_of: str | None = None):
    def plan(s, d):
        facts = _facts(s, d)
        views.create_views({t: facts[t]() for t in ("price_daily", "delivery_daily", "listing", "instrument_master")}, as_of, "_q")
        return s.sql(sql)

    return plan


def _mart(s, d):
    views.create_views({"price_daily": market.price_daily(s, d)}, None, "_m")
    sql = "SELECT isin, count(*) AS days, max(spread_bps) AS widest FROM int_venue_spread_m GROUP BY isin"
    return views.write_marts(s, {"spread_by_isin": sql}, _folder(s))["spread_by_isin"]


def _folder(s: SparkSession) -> str:
    """A folder of this run's own in the warehouse, which a cluster shares."""
    return s.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_queries/{uuid.uuid4().hex}"


def _facts_by_year(s, d):
    path = _folder(s)
    sinks.append_facts(market.delivery_daily(s, d).where("as_of_date < DATE '1997-06-01'"), path, "delivery_daily")
    sinks.append_facts(market.delivery_daily(s, d).where("as_of_date >= DATE '1997-06-01'"), path, "delivery_daily")
    return sinks.read_facts(s, path, "1996-02-01", "1997-10-31")


def _names(s, d):
    return _table(s, d, "events").select(market.isin(F.col("user_id")).alias("isin"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 4).cast("string")).alias("name"), (F.col("user_id") % 4 != 0).alias("is_current_format"), (F.col("event_id") % 2).cast("int").alias("venue_order"), F.col("ts").cast("date").alias("trade_date"))


def _misdated(s, d):
    late = F.when(F.col("volume") % 50 == 0, F.add_months("trade_date", 1)).otherwise(F.col("trade_date"))
    return validation.day_verdicts(_price(s, d).withColumn("read_day", late), read_for="read_day")


def _merged_listings(s, d):
    old = _customer_listings(s, d).where("isin < 'IN0000010000'").withColumns({"delisting_date": F.lit(None).cast("date"), "closure_reason": F.lit(None).cast("string")})
    return sinks.merge_listings(old, _customer_listings(s, d).withColumn("scrip_code", F.lit("new")))


def _spans_added(s, d):
    spans = identity.derive_primary_venue(_price(s, d))
    return sinks.add_primary_venues(spans.where("venue = 'BSE'"), spans.withColumn("effective_to", F.lit(None).cast("date")))


def _verdicts_added(s, d):
    days = _days(s, d).drop("detail")
    return sinks.add_verdicts(days.where("venue = 'BSE'"), days.withColumn("bars", F.lit(-1)))


def _lined(s, d):
    return market.observations(s, d).withColumn("line", F.col("local_symbol")).select("isin", "venue", "line", "trade_date", "turnover")


def _dominant_rows(s, d):
    return identity.dominant_only(_lined(s, d), identity.dominant_line(_lined(s, d))).groupBy("isin", "venue", "line").agg(F.count("*").alias("n"))


def _counters(s, d):
    return survey.run_counters(market.instruments(s, d), _price(s, d), identity.dominant_line(_lined(s, d)), market.corporate_action(s, d))


def _series(s, d):
    return _table(s, d, "events").select("user_id", _pick(("EQ", "BE", "GB", "TB", "BZ", "N1", "SM"), F.col("event_id")).alias("series"))


def _excluded(s, d):
    rows = _series(s, d)
    return quality.shared(files.equity_only(rows, "NSE"), rows.where("series IN ('GB', 'TB')"), "user_id")


def _tracks(s, d):
    return survey.track_survey(_price(s, d).withColumn("local_symbol", F.concat(F.lit("S"), F.year("trade_date").cast("string"))))


def _scalars(s, d):
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    return _table(s, d, "customer").select(
        "c_custkey", scalars.collapse_spaces(F.concat(F.lit("  "), name, F.lit(" \t "), "c_mktsegment", F.lit("\n"))).alias("collapsed"), scalars.strip_zeros(F.concat(F.lit("00"), F.when(F.col("c_nationkey") == 0, "0").otherwise(key))).alias("stripped"),
        scalars.blank_to_null(F.when(F.col("c_nationkey") < 5, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))).alias("filled"), scalars.is_isin(F.concat(F.lit("IN"), F.lpad(key, 9, "0"), F.when(F.col("c_nationkey") < 12, "0").otherwise("x"))).alias("isin_form"),
        scalars.half_even((F.col("c_custkey") * 10 + 5).cast("decimal(18,5)") * F.lit("0.00001").cast("decimal(6,5)")).alias("even"), scalars.no_places(F.col("c_custkey").cast("double") * 500.5).alias("whole"),
        F.lower("c_mktsegment").alias("lower"), F.startswith(F.upper(name), F.lit("CUSTOMER#")).alias("starts"),
    )


def _dates(s, d):
    day = F.col("o_orderdate").cast("date")
    patterns = {"iso": "yyyy-MM-dd", "short_year": "dd-MMM-yy", "month_name": "dd-MMM-yyyy", "digits": "ddMMyyyy", "compact": "yyyyMMdd"}
    return _table(s, d, "orders").select("o_orderkey", *(scalars.market_date(F.concat(F.lit(" "), F.date_format(day, p)), p).alias(n) for n, p in patterns.items()))


def _fresh(s, d):
    bars = market.customer_bars(s, d).withColumn("trade_date", F.trunc("trade_date", "month"))
    return identity.fresh_isins(bars, market.corporate_action(s, d).select("isin", "action_type", "ex_date", "o_orderkey"))


def _absent(s, d):
    """Columns that each of a set of headers lacks: one header an order, with one column renamed and one padded by its key."""
    names = F.array(*map(F.lit, files.UDIFF.values()))
    key = (F.col("o_orderkey") % 14).cast("int")
    header = F.array_join(F.transform(names, lambda n, i: F.when(i == key, F.concat(n, F.lit("_old"))).when(i == (key + 1) % 14, F.concat(F.lit("  "), n, F.lit(" "))).otherwise(n)), ",")
    headed = _table(s, d, "orders").select("o_orderkey", header.alias("header"))
    return quality.lacking(headed, "header", files.UDIFF.values()).groupBy("missing").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


def _gate(s, d):
    """What the gate for instruments that can't be named says of parts' codes."""
    codes = _table(s, d, "part").select(F.when(F.col("p_size") > 25, market.isin(F.col("p_partkey"))).otherwise(F.concat("p_brand", F.lit("-"), "p_size")).alias("isin"))
    try:
        identity.require_resolvable(codes)
        said = "nothing"
    except identity.UnresolvableInstrument as e:
        said = str(e)
    return codes.agg(F.count("*").alias("rows")).select("rows", F.lit(said).alias("said"))


def _unaccepted(s, d):
    actions = market.corporate_action(s, d)
    counted = quality.unaccepted(actions, "action_type", COUNT_CHANGING).groupBy("action_type").agg(F.count("*").alias("n"))
    return counted.unionByName(quality.nulls(actions, "ratio_from", "ratio_to").agg(F.lit("no ratio").alias("action_type"), F.count("*").alias("n")))


def _export(table: str, *columns: str) -> str:
    return "SELECT concat_ws(',', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns) + f") AS line FROM {table}"


APART_SQL = f"printf('{APART}', CAST(n AS VARCHAR), CAST(CAST(round_even(worst, 0) AS BIGINT) AS VARCHAR))"
LATEST_SPREAD = """
spread AS (
  SELECT isin, trade_date, as_of_date, CAST((400000000 * CAST(abs(b - n) * 10000 AS HUGEINT) + CAST((b + n) * 10000 AS HUGEINT)) // (2 * CAST((b + n) * 10000 AS HUGEINT)) AS DOUBLE) / 10000 AS bps
  FROM (SELECT isin, trade_date, max(as_of_date) AS as_of_date, max(close) FILTER (WHERE venue = 'BSE') AS b, max(close) FILTER (WHERE venue = 'NSE') AS n FROM known GROUP BY ALL) WHERE b IS NOT NULL AND n IS NOT NULL)"""


def entries(divergent: str, primary: str, tracks: str) -> dict[str, tuple]:
    """Name to (plan, extra common table expressions, select), as in the catalogue."""
    known = lambda as_of: f"known AS (SELECT * FROM price_daily WHERE as_of_date <= DATE '{as_of}' QUALIFY row_number() OVER (PARTITION BY isin, venue, trade_date ORDER BY as_of_date DESC) = 1),"
    return {
        "parse_udiff_bse": (lambda s, d: _shown(files.read_rows(_udiff(s, d), "BSE", "udiff")), FILE_ROWS, _bars_sql("BSE", "symbol", "code")),
        "parse_udiff_nse": (lambda s, d: _shown(files.read_rows(_udiff(s, d), "NSE", "udiff")), FILE_ROWS, _bars_sql("NSE", "symbol", "CAST(NULL AS VARCHAR)")),
        "parse_bse_legacy": (lambda s, d: _shown(files.read_rows(_bse_legacy(s, d), "BSE", "legacy")), FILE_ROWS, _bars_sql("BSE", "code", "code")),
        "parse_nse_legacy": (lambda s, d: _shown(files.read_rows(_nse_legacy(s, d), "NSE", "legacy")), FILE_ROWS, _bars_sql("NSE", "symbol", "CAST(NULL AS VARCHAR)")),
        "concatenated_bars": (
            lambda s, d: _all_bars(s, d).groupBy("venue", "trade_date").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"), F.count("scrip_code").alias("codes")), FILE_ROWS,
            f"SELECT venue, CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume, count(scrip_code) AS codes FROM ({_bars_sql('BSE', 'code', 'code')} UNION ALL {_bars_sql('NSE', 'symbol', 'CAST(NULL AS VARCHAR)')} UNION ALL {_bars_sql('BSE', 'symbol', 'code')}) GROUP BY ALL"),
        "bars_by_version": (
            _bars_by_version, FILE_ROWS,
            f"SELECT * FROM ({_bars_sql('BSE', 'code', 'code')} AND day <= DATE '1997-12-31') UNION ALL SELECT * FROM ({_bars_sql('BSE', 'symbol', 'code')} AND day >= DATE '1998-02-01')"),
        "parse_nse_delivery": (lambda s, d: files.parse_nse_delivery(_nse_delivery(s, d)), FILE_ROWS, "SELECT symbol AS venue_key, CAST(day AS VARCHAR) AS trade_date, volume AS delivery_quantity FROM file_rows WHERE series <> 'GB'"),
        "parse_bse_delivery": (lambda s, d: files.parse_bse_delivery(_bse_delivery(s, d), "DATE|SCRIP CODE|DELIVERY QTY|X"), FILE_ROWS, "SELECT code AS venue_key, CAST(day AS VARCHAR) AS trade_date, volume AS delivery_quantity FROM file_rows WHERE series NOT IN ('X', 'G')"),
        "parsed_actions": (
            lambda s, d: _actions(s, d)[0], ANNOUNCED,
            f"SELECT isin, action_type, CAST(ex_date AS VARCHAR) AS ex_date, 'bse_actions' AS source_id, '{REPORTED}' AS as_of_date, qualifier, ratio_from, ratio_to, CAST(dividend_amount AS DOUBLE) AS dividend_amount FROM terms WHERE action_type <> 'unhandled' QUALIFY row_number() OVER (PARTITION BY isin, action_type, terms.ex_date, qualifier ORDER BY k) = 1"),
        "unhandled_actions": (lambda s, d: _actions(s, d)[1], ANNOUNCED, "SELECT isin, 'Scheme of Arrangement' AS purpose, strftime(ex_date, '%Y%m%d') AS exdate FROM terms WHERE action_type = 'unhandled'"),
        "scrip_dimension": (lambda s, d: files.bse_scrips(_customer_listings(s, d)), CUSTOMER_LISTINGS, "SELECT scrip_code, isin FROM customer_listings WHERE exchange = 'BSE'"),
        "unzipped": (_archives, "", "SELECT n_name AS path, CASE WHEN n_regionkey > 1 THEN CAST(n_regionkey AS VARCHAR) END AS region, n_regionkey < 2 AS failed FROM nation"),
        "landed_files": (_landed, "", "SELECT page_id FROM pages WHERE NOT starts_with(regexp_replace(CASE WHEN length(url) % 3 = 0 THEN url ELSE '' END || coalesce(html, ''), '^\\s+', ''), '<')"),
        "unresolvable_isins": (_unresolvable, "", "SELECT isin, count(*) AS n FROM (SELECT CASE WHEN p_size > 25 THEN 'IN' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '0' WHEN p_size > 3 THEN p_brand END AS isin FROM part) WHERE isin IS NULL OR NOT regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{9}[0-9]') GROUP BY 1"),
        "seed_rescan": (lambda s, d: sinks.parse_seed(sinks.csv_lines(_customer_listings(s, d), "listing"), "listing"), CUSTOMER_LISTINGS, f"SELECT {LISTING_TEXT} FROM customer_listings"),
        "export_prices": (_lines("price_daily"), "", _export("price_daily", "isin", "venue", "trade_date", "as_of_date", "open", "high", "low", "close", "previous_close", "volume", "turnover", "trade_count")),
        "export_deliveries": (_lines("delivery_daily"), "", _export("delivery_daily", "isin", "venue", "trade_date", "as_of_date", "delivery_quantity")),
        "export_actions": (_lines("corporate_action"), "", _export("corporate_action", "isin", "action_type", "ex_date", "source_id", "as_of_date", "qualifier", "ratio_from", "ratio_to", "dividend_amount")),
        "export_listings": (_lines("listing"), CUSTOMER_LISTINGS, _export("customer_listings", "isin", "exchange", "local_symbol", "scrip_code", "listing_date", "delisting_date", "closure_reason")),
        "export_days": (_lines("trading_day"), divergent, _export("verdicts", "venue", "trade_date", "trade_date", "detail IS NULL", "bars", "divergent_instruments", "CASE WHEN contains(detail, ',') THEN '\"' || detail || '\"' ELSE detail END")),
        "export_instruments": (_lines("instrument_master"), "", _export("(SELECT DISTINCT p.isin, coalesce(name, p.isin) AS name FROM latest_price p LEFT JOIN instruments i ON p.isin = i.isin)", "isin", "name", "NULL", "'IN'", "'equity'")),
        "view_spread": (_view("SELECT isin, trade_date, as_of_date, spread_bps AS bps FROM int_venue_spread_q WHERE spread_bps < 9000"), known("9999-12-31") + LATEST_SPREAD, "SELECT isin, CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of_date AS VARCHAR) AS as_of_date, bps FROM spread WHERE bps < 9000"),
        "view_spread_asof": (_view("SELECT isin, trade_date, as_of_date, spread_bps AS bps FROM int_venue_spread_q", "1997-03-10"), known("1997-03-10") + LATEST_SPREAD, "SELECT isin, CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of_date AS VARCHAR) AS as_of_date, bps FROM spread"),
        "view_listings": (
            _view("SELECT l.isin, l.exchange, l.local_symbol, i.name, i.country, i.instrument_type FROM stg_listings_q l JOIN stg_instruments_q i ON l.isin = i.isin"), CUSTOMER_LISTINGS,
            "SELECT l.isin, exchange, local_symbol, coalesce(name, l.isin) AS name, 'IN' AS country, 'equity' AS instrument_type FROM customer_listings l JOIN (SELECT DISTINCT isin FROM latest_price) p ON l.isin = p.isin LEFT JOIN instruments i ON l.isin = i.isin"),
        "mart_spread": (_mart, known("9999-12-31") + LATEST_SPREAD, "SELECT isin, count(*) AS days, max(bps) AS widest FROM spread GROUP BY 1"),
        "facts_by_year": (_facts_by_year, "", "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of_date AS VARCHAR) AS as_of_date, delivery_quantity FROM delivery_daily WHERE trade_date BETWEEN DATE '1996-02-01' AND DATE '1997-10-31'"),
        "chosen_names": (
            lambda s, d: identity.choose_names(_names(s, d)), "",
            "SELECT isin, name FROM (SELECT 'IN' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '0' AS isin, event_type || ' ' || event_id % 4 AS name, user_id % 4 <> 0 AS fresh, event_id % 2 AS venue_order, CAST(ts AS DATE) AS day FROM events) QUALIFY row_number() OVER (PARTITION BY isin ORDER BY CASE WHEN fresh THEN -venue_order ELSE 0 END, CASE WHEN fresh THEN -epoch(day) ELSE epoch(day) END, CASE WHEN fresh THEN 0 ELSE venue_order END, CASE WHEN fresh THEN name END DESC NULLS LAST, name) = 1"),
        "misdated_days": (
            _misdated, divergent,
            f"""SELECT c.venue, CAST(c.trade_date AS VARCHAR) AS trade_date, CAST(c.trade_date AS VARCHAR) AS as_of_date, NOT mis AND n IS NULL AS is_complete, bars, coalesce(n, 0) AS divergent_instruments,
  nullif(concat_ws('; ', CASE WHEN mis THEN '{MISDATED}' END, CASE WHEN n > 0 THEN {APART_SQL} END), '') AS detail
FROM (SELECT venue, rd AS trade_date, count(*) AS bars, bool_or(rd <> trade_date) AS mis FROM (SELECT venue, trade_date, CASE WHEN volume % 50 = 0 THEN CAST(trade_date + INTERVAL 1 MONTH AS DATE) ELSE trade_date END AS rd FROM latest_price) GROUP BY 1, 2) c
LEFT JOIN (SELECT trade_date, count(*) AS n, max(bps) AS worst FROM divergent GROUP BY 1) w ON c.trade_date = w.trade_date"""),
        "listing_merge": (
            _merged_listings, CUSTOMER_LISTINGS,
            f"SELECT {LISTING_TEXT.replace('scrip_code,', chr(39).join(['CASE WHEN isin < ', 'IN0000010000', ' THEN scrip_code ELSE ', 'new', ' END AS scrip_code,']))} FROM customer_listings"),
        "primary_venue_insert": (_spans_added, primary, "SELECT isin, CAST(effective_from AS VARCHAR) AS effective_from, CAST(as_of_date AS VARCHAR) AS as_of_date, CASE WHEN venue = 'BSE' THEN CAST(effective_to AS VARCHAR) END AS effective_to, venue FROM primary_venue"),
        "verdict_insert": (_verdicts_added, divergent, "SELECT venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(trade_date AS VARCHAR) AS as_of_date, detail IS NULL AS is_complete, CASE WHEN venue = 'BSE' THEN bars ELSE -1 END AS bars, divergent_instruments FROM verdicts"),
        "dominant_rows": (
            _dominant_rows, "",
            "SELECT o.isin, o.venue, local_symbol AS line, count(*) AS n FROM observations o SEMI JOIN (SELECT * FROM (SELECT isin, venue, local_symbol AS line, sum(turnover) AS t FROM observations GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY isin, venue ORDER BY t DESC, line) = 1) w ON o.isin = w.isin AND o.venue = w.venue AND local_symbol = line GROUP BY ALL"),
        "run_counters": (_counters, "", "SELECT (SELECT count(*) FROM instruments) AS instruments, (SELECT count(*) FROM latest_price) AS price_rows, (SELECT count(*) FROM (SELECT DISTINCT isin, venue FROM observations)) AS lines, (SELECT count(*) FROM corporate_action) AS actions"),
        "excluded_isins": (_excluded, "", "SELECT user_id FROM (SELECT user_id, event_id % 7 AS n FROM events) WHERE n IN (0, 1, 4, 6) INTERSECT SELECT user_id FROM (SELECT user_id, event_id % 7 AS n FROM events) WHERE n IN (2, 3)"),
        "survey_round_trip": (lambda s, d: survey.read_survey(survey.survey_json(_tracks(s, d)), _tracks(s, d)), tracks, "SELECT isin, venue, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, days, symbols, CAST(turnover AS DOUBLE) AS turnover, worst_ratio, CAST(worst_ratio_day AS VARCHAR) AS worst_ratio_day, longest_gap FROM tracks"),
        "text_scalars": (
            _scalars, "",
            "SELECT c_custkey, c_name || ' ' || c_mktsegment AS collapsed, CASE WHEN c_nationkey = 0 THEN '0' ELSE CAST(c_custkey AS VARCHAR) END AS stripped, CASE WHEN c_nationkey >= 5 THEN c_mktsegment END AS filled, c_nationkey < 12 AS isin_form, CAST(c_custkey + c_custkey % 2 AS DOUBLE) / 10000 AS even, CAST(CAST(round_even(c_custkey * 500.5, 0) AS BIGINT) AS VARCHAR) AS whole, lower(c_mktsegment) AS lower, starts_with(upper(c_name), 'CUSTOMER#') AS starts FROM customer"),
        "date_formats": (_dates, "", "SELECT o_orderkey, " + ", ".join(f"CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS {n}" for n in ("iso", "short_year", "month_name", "digits", "compact")) + " FROM orders"),
        "fresh_isins": (
            _fresh, "",
            "SELECT c.isin, action_type, CAST(ex_date AS VARCHAR) AS ex_date, o_orderkey, CAST(first_day AS VARCHAR) AS first_day FROM corporate_action c JOIN (SELECT isin, CAST(date_trunc('month', min(trade_date)) AS DATE) AS first_day FROM customer_bars GROUP BY 1) f ON c.isin = f.isin AND ex_date = first_day"),
        "missing_columns": (
            _absent, "",
            f"SELECT missing, count(*) AS n, min(o_orderkey) AS least FROM (SELECT o_orderkey, list_extract({list(files.UDIFF.values())}, CAST(o_orderkey % 14 + 1 AS INTEGER)) AS missing FROM orders) GROUP BY 1"),
        "resolvability_gate": (
            _gate, "",
            "SELECT (SELECT count(*) FROM part) AS rows, (SELECT count(*) FROM part WHERE p_size <= 25) || ' rows without a valid ISIN: [' || string_agg(chr(39) || code || chr(39), ', ' ORDER BY code) || ']' AS said FROM (SELECT DISTINCT p_brand || '-' || p_size AS code FROM part WHERE p_size <= 25 ORDER BY 1 LIMIT 5)"),
        "unaccepted_values": (_unaccepted, "", "SELECT action_type, count(*) AS n FROM corporate_action WHERE action_type NOT IN ('split', 'bonus', 'consolidation') GROUP BY 1 UNION ALL SELECT 'no ratio', count(*) FROM corporate_action WHERE ratio_from IS NULL OR ratio_to IS NULL"),
    }
