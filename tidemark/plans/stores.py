"""Registered queries of landing, day files and stored tables: written from the test tables, and SQL for what must come back."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, identity, spreads
from tidemark.plans import market, readers
from tidemark.sources import counters, day_files, exports, files, registry, sinks, snapshots
from tidemark.sources.snapshots import Store

VENUES = {"bse_bars": "BSE", "nse_bars": "NSE"}
VERSIONS = "\n".join(
    f"""
[[source]]
source_id = "{s}"
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
    for s in VENUES
)


def fresh(s: SparkSession, d: str, name: str) -> str:
    """An empty folder of a query over one set of tables, in the warehouse, which a cluster shares; what a run before left is deleted."""
    path = f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_queries/{name}-{zlib.crc32(d.encode()):08x}"
    place = s._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(s._jsc.hadoopConfiguration()).delete(place, True)
    return path


def _day_lines(s: SparkSession, d: str) -> DataFrame:
    """``source_id``, ``day``, ``flaw``, ``head`` and ``line``: line items as the files of two venues, one for each month.

    A month's file is that of its first Monday after the first. In some months the file is a web page, lacks a
    column, is no archive or holds two entries.
    """
    month = F.trunc("day", "month")
    rows = readers._text(s, d).withColumn("source_id", F.when(F.col("code").cast("long") % 2 == 0, "bse_bars").otherwise("nse_bars")).withColumn("day", F.next_day(month, "Mon"))
    new, bse = F.col("day") >= F.lit("1998-01-01").cast("date"), F.col("source_id") == "bse_bars"
    stamp = F.when(new, F.date_format("day", "yyyy-MM-dd")).when(bse, F.date_format("day", "dd-MMM-yy")).otherwise(F.upper(F.date_format("day", "dd-MMM-yyyy")))
    rows = rows.withColumns({"trade_date": stamp, "instrument_id": F.col("code"), "isin": F.when(~new & bse, F.rpad("isin", 14, " ")).otherwise(F.col("isin"))})
    line = lambda layout: F.concat_ws(",", *map(F.col, layout))
    head = lambda layout: F.lit(",".join(layout.values()))
    pick = lambda make: F.when(new, make(files.UDIFF)).when(bse, make(files.BSE_LEGACY)).otherwise(make(files.NSE_LEGACY))
    m = F.month("day")
    flaw = F.when(m == 7, "page").when(m == 9, "drift").when((m == 5) & ~bse, "two").when((m == 11) & ~bse, "broken").otherwise("")
    return rows.select("source_id", "day", flaw.alias("flaw"), pick(head).alias("head"), pick(line).alias("line"))


def _landed_days(s: SparkSession, d: str, name: str, lines: bool = True) -> DataFrame:
    """The scan of landed day files: those of BSE plain, those of NSE zipped. Lines travel one by one, so no file is held whole."""
    rows = _day_lines(s, d)
    drifted = F.when(F.col("flaw") == "drift", F.regexp_replace("head", "OPEN|OpnPric", "Spare")).otherwise(F.col("head"))
    zipped, whole = F.col("source_id") == "nse_bars", F.col("flaw").isin("page", "broken")
    first = F.when(F.col("flaw") == "page", "  <html>none</html>").when(F.col("flaw") == "broken", "no archive").otherwise(F.concat(drifted, F.lit("\n")))
    heads = rows.select("source_id", "day", "flaw", "head").distinct().select("source_id", "day", "flaw", F.lit(0).alias("at"), first.alias("text"))
    body = rows.where(~whole).select("source_id", "day", "flaw", F.lit(1).alias("at"), F.concat("line", F.lit("\n")).alias("text"))
    entries = F.when(~zipped | whole, F.array(F.lit(None).cast("string"))).when(F.col("flaw") == "two", F.array(F.lit("bars0.CSV"), F.lit("bars1.CSV"))).otherwise(F.array(F.lit("bars0.CSV")))
    pieces = heads.unionByName(body).select("source_id", F.date_format("day", "yyyyMMdd").alias("partition"), F.when(zipped, ".zip").otherwise(".csv").alias("suffix"), F.explode(entries).alias("entry"), "at", F.col("text").cast("binary").alias("content"))
    root = fresh(s, d, name)
    day_files.land_pieces(pieces, root)
    return day_files.scan_days(s, root, VENUES, registry.load_registry(s, VERSIONS)[1], lines)


def _days(s, d):
    """Bars of all readable files, as in the parse queries."""
    rows = day_files.typed(_landed_days(s, d, "day_bars")).where(day_files.equity_of_venue())
    return readers._shown(rows.drop("day", "series"))


def _pruned(s, d):
    """Files of one venue and year: the filters reach the list of files."""
    scanned = _landed_days(s, d, "day_bars_pruned").where("source_id = 'nse_bars' AND day >= DATE '1996-02-01' AND day < DATE '1997-01-01'")
    return scanned.groupBy("path", "version").agg(F.count("at").alias("n"), F.max("error").alias("error"))


def _counted(s, d):
    """Bars and actions are written once, and the counts come with the writes."""
    text = readers._text(s, d)
    rows = text.withColumn("venue", F.when(F.col("code").cast("long") % 2 == 0, "BSE").otherwise("NSE")).withColumn("series", F.when(F.col("volume") != "13", F.col("series")))
    bars, seen = counters.equity_counted(rows)
    bars.write.parquet(fresh(s, d, "counted_bars"))
    records = files.parse_actions(readers._payloads(s, d))
    actions, told = counters.actions_counted(records, files.bse_scrips(readers._customer_listings(s, d)), readers.REPORTED, "bse_actions")
    actions.write.parquet(fresh(s, d, "counted_actions"))
    return s.createDataFrame(counters.as_rows(seen, "bars") + counters.as_rows(told, "actions"), "run string, what string, code string, n long")


def _appended(s, d):
    """Deliveries in three appends that overlap: the first half, all but some, all of them again."""
    facts, store = market.delivery_daily(s, d), Store(s, fresh(s, d, "appended"))
    for some in ("as_of_date < DATE '1997-06-01'", "delivery_quantity % 7 <> 0", "true"):
        snapshots.append_new(store, facts.where(some), "delivery_daily")
    return store.read()


def _maintained(s, d):
    """The latest price of each key after ten batches of versions, some of them late."""
    arrived, store = fresh(s, d, "arrived"), Store(s, fresh(s, d, "maintained"))
    facts = market.price_daily(s, d)
    # Each file is sorted by batch, so that a batch reads its own pages of it.
    facts.withColumn("batch", F.pmod(F.xxhash64("isin", "as_of_date"), F.lit(10))).sortWithinPartitions("batch").write.parquet(arrived)
    arrivals = s.read.parquet(arrived)
    for i in range(10):
        snapshots.keep_latest(store, arrivals.where(F.col("batch") == i).drop("batch"), asof.PRICE_KEYS, batch_id=i)
    return store.read()


def bucketed(s: SparkSession, d: str, query: str = "bucketed") -> tuple[DataFrame, DataFrame]:
    """Prices and deliveries as tables laid out by key, each query's its own; folders that a session before left are replaced."""
    made = {"price": market.price_daily(s, d), "delivery": market.delivery_daily(s, d)}
    return tuple(sinks.save_bucketed(facts, f"{query}_{name}_{zlib.crc32(d.encode()):08x}", 8, path=fresh(s, d, f"{query}_{name}")) for name, facts in made.items())


def _participation(s, d):
    prices, deliveries = bucketed(s, d, "participation_bucketed")
    return spreads.delivery_participation(asof.latest_price(prices), asof.latest_delivery(deliveries))


def _sources(s, d):
    """Nations as sources: the tier is the region, the number of customers the rate."""
    n = readers._table(s, d, "nation")
    rate = readers._table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count("*") % 90 + 1).cast("decimal(6,3)").alias("rate"))
    return n.join(rate, "n_nationkey").select("n_nationkey", F.col("n_name").alias("source_id"), (F.col("n_regionkey") % 4 + 1).cast("short").alias("tier"), F.lit(None).cast("string").alias("sebi_curation_ref"), F.concat(F.lit("https://example.org/"), "n_nationkey").alias("base_url"), F.col("rate").alias("requests_per_second"), F.lit("keep").alias("cache_policy"), F.lit(None).cast("string").alias("owner_notes"))


def _versions(s, d):
    """Each nation's suppliers as versions: one begins with each of the first days of their sales."""
    sold = readers._table(s, d, "lineitem").join(readers._table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(readers._table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return sold.groupBy(F.col("n_name").alias("source_id"), F.trunc(F.col("l_shipdate").cast("date"), "year").alias("effective_from")).agg(F.concat(F.lit("v"), F.min("l_suppkey")).alias("version")).withColumn("effective_to", F.last_day(F.add_months("effective_from", 11)))


def _synced(s, d):
    """A registry of all nations, then a sync of some of them: new addresses, and versions from 1996 on; every eleventh loses its versions."""
    root, sources, versions = fresh(s, d, "registry"), _sources(s, d), _versions(s, d)
    snapshots.sync_registry(s, root, sources.drop("n_nationkey"), versions)
    some = sources.where("n_nationkey % 3 = 1").withColumn("base_url", F.concat("base_url", F.lit("/new"))).drop("n_nationkey")
    later = versions.where("effective_from >= DATE '1996-01-01'").join(sources.where("n_nationkey % 3 = 1 AND n_nationkey % 11 <> 1").select("source_id"), "source_id", "left_semi")
    snapshots.sync_registry(s, root, some, later.select("source_id", "effective_from", F.concat("version", F.lit("b")).alias("version"), "effective_to"))
    kept = Store(s, f"{root}/source_registry").read().select("source_id", "tier", "base_url", "requests_per_second")
    return kept.join(Store(s, f"{root}/source_schema_version").read(), "source_id", "left")


def _merged_listings(s, d):
    """Listings of some customers, then a merge of all: closed ones close, new ones come."""
    store, listings = Store(s, fresh(s, d, "listings")), readers._customer_listings(s, d)
    opened = listings.where("isin < 'IN0000010000'").withColumns({"delisting_date": F.lit(None).cast("date"), "closure_reason": F.lit(None).cast("string")})
    store.replace(opened)
    snapshots.merge_into(store, listings.withColumn("scrip_code", F.lit("new")), snapshots.MERGES["listing"])
    return store.read()


def _exported(s, d):
    """The latest prices as an ordered text, read back with their place in it."""
    path = fresh(s, d, "exported")
    exports.export_ordered(asof.latest_price(market.price_daily(s, d)), "price_daily", path)
    return exports.numbered(exports.read_export(s, path, "price_daily")).select("n", "isin", "venue", "trade_date", "close", "previous_close")


def _disorder(s, d):
    """How many rows of an ordered export, and of the same lines in another order, stand before a smaller one."""
    ordered, mixed = fresh(s, d, "ordered"), fresh(s, d, "mixed")
    exports.export_ordered(readers._customer_listings(s, d), "listing", ordered)
    s.read.text(ordered).orderBy(F.reverse("value")).coalesce(1).write.text(mixed)
    keys = sinks.EXPORT_ORDER["listing"]
    found = exports.disorder(exports.read_export(s, ordered, "listing"), keys).agg(F.count("*").alias("ordered"))
    rows = exports.read_text_table(exports.numbered_lines(s, mixed), "listing", exports.header_of(s, ordered))
    return found.select("ordered", F.lit(not exports.disorder(rows, keys).isEmpty()).alias("mixed"))


def _loaded(s, d):
    """Exports of three tables of one another, loaded in key order; then prices of unknown instruments, which are refused."""
    folder, root = fresh(s, d, "seed"), fresh(s, d, "loaded")
    facts = readers._facts(s, d)
    known = facts["instrument_master"]()
    for table, rows in (("instrument_master", known), ("price_daily", facts["price_daily"]()), ("delivery_daily", facts["delivery_daily"]()), ("listing", facts["listing"]().join(known.select("isin"), "isin", "left_semi"))):
        exports.export_ordered(rows, table, f"{folder}/{table}.csv")
    exports.bulk_load(s, folder, root)
    late = fresh(s, d, "seed_late")
    exports.export_ordered(market.customer_bars(s, d).distinct().select("isin", "venue", "trade_date", F.col("trade_date").alias("as_of_date"), F.lit(1).alias("delivery_quantity")), "delivery_daily", f"{late}/delivery_daily.csv")
    try:
        exports.bulk_load(s, late, root)
        refused = "nothing"
    except exports.ForeignKeyViolation as e:
        refused = str(e).split(":")[0]
    counted = [Store(s, f"{root}/{t}").read().agg(F.lit(t).alias("table"), F.count("*").alias("n")) for t in ("instrument_master", "listing", "price_daily", "delivery_daily")]
    return files.concatenate(*counted).withColumn("refused", F.lit(refused))


def _order_spans(s, d):
    """Spans of customers' orders as listings of one venue, with days that none and days that several hold."""
    days = market.customer_bars(s, d).select("isin", "trade_date").distinct().where("day(trade_date) > 8")
    return days.select("isin", F.lit("NSE").alias("exchange"), F.concat(F.lit("S"), F.date_format("trade_date", "yyyyMMdd")).alias("local_symbol"), F.lit(None).cast("string").alias("scrip_code"), F.col("trade_date").alias("listing_date"),
                       F.when(F.day("trade_date") != 13, F.date_add("trade_date", 90 + F.day("trade_date"))).alias("delisting_date"))


def _matches(s, d):
    found = identity.listing_matches(market.customer_bars(s, d), _order_spans(s, d))
    return found.select("isin", "trade_date", "matches", F.col("span.listed_symbol").alias("listed_symbol"))


def _exact(s, d):
    """Orders of customers that are listed throughout, on their own venue."""
    held = readers._customer_listings(s, d)
    bars = market.customer_bars(s, d).where("trade_date >= DATE '1995-01-02'").drop("venue").join(held.where("delisting_date IS NULL").select("isin", F.col("exchange").alias("venue")), "isin").select("isin", "venue", "trade_date").distinct()
    return identity.exactly_in_force(bars, held).drop("delisting_date")


def _handed_on(s, d):
    """Keys that pass from customer to customer: some days nobody has one, some days two do."""
    k = F.col("c_custkey")
    start = F.date_add(F.lit("1992-01-01").cast("date"), (F.floor(k / 50) * 200).cast("int"))
    held = F.when(k % 7 == 0, 230).when(k % 7 == 1, 150).otherwise(199)
    return readers._table(s, d, "customer").select(market.isin(k).alias("isin"), F.lit("BSE").alias("exchange"), F.lit("x").alias("local_symbol"), F.concat(F.lit("K"), (k % 50).cast("string")).alias("scrip_code"), start.alias("listing_date"), F.date_add(start, held).alias("delisting_date"))


def _dated(s, d, which: int):
    rows = readers._table(s, d, "orders").select(F.concat(F.lit("K"), (F.col("o_custkey") % 50).cast("string")).alias("venue_key"), F.col("o_orderdate").cast("date").alias("trade_date"), "o_orderkey")
    return identity.resolve_dated_keys(rows, _handed_on(s, d), "BSE")[which]


MONTH_FILES = """
month_files AS (
  SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'bse_bars' ELSE 'nse_bars' END AS source_id, m + CAST(8 - isodow(m) AS INTEGER) AS file_day
  FROM (SELECT *, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS m FROM lineitem)),
states AS (
  SELECT source_id, file_day, count(*) AS n, CASE WHEN month(file_day) = 7 THEN 'not published: a web page' WHEN month(file_day) = 5 AND source_id = 'nse_bars' THEN 'failed: 2 entries where one is expected' WHEN month(file_day) = 11 AND source_id = 'nse_bars' THEN 'failed: no archive'
    WHEN file_day BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' THEN 'failed: no schema version in force' WHEN month(file_day) = 9 THEN 'failed: columns are missing: ' || CASE WHEN file_day >= DATE '1998-01-01' THEN 'OpnPric' ELSE 'OPEN' END END AS error
  FROM month_files GROUP BY ALL),
file_paths AS (SELECT *, source_id || '/' || strftime(file_day, '%Y%m%d') || CASE WHEN source_id = 'bse_bars' THEN '.csv' ELSE '.zip' END AS path FROM states)"""


def _bars_sql(venue: str, source: str) -> str:
    symbol = "CASE WHEN new THEN symbol ELSE code END" if venue == "BSE" else "symbol"
    return readers._bars_sql(venue, symbol, "code" if venue == "BSE" else "CAST(NULL AS VARCHAR)").replace("FROM file_rows", f"FROM day_rows WHERE source_id = '{source}' AND TRUE").replace("AND TRUE WHERE", "AND")


DAY_ROWS = (
    MONTH_FILES
    + f""",
day_rows AS (
  SELECT f.file_day AS day, f.source_id, f.file_day >= DATE '1998-01-01' AS new, CAST(l_partkey AS VARCHAR) AS code, 'IN' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '0' AS isin, 'T' || l_suppkey AS symbol, list_extract({list(readers.SERIES)}, CAST((l_linenumber + l_partkey) % 7 + 1 AS INTEGER)) AS series,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_quantity AS BIGINT) AS volume, l_linenumber AS n
  FROM month_files f JOIN states s ON f.source_id = s.source_id AND f.file_day = s.file_day WHERE error IS NULL)"""
)
COUNTED = """
series_rows AS (
  SELECT CASE WHEN l_partkey % 2 = 0 THEN 'BSE' ELSE 'NSE' END AS venue, CASE WHEN l_quantity <> 13 THEN list_extract(['A', 'EQ', 'G', 'B', 'BE', 'X', 'GB'], CAST((l_linenumber + l_partkey) % 7 + 1 AS INTEGER)) END AS series FROM lineitem),
judged_rows AS (SELECT *, coalesce(CASE venue WHEN 'BSE' THEN series IN ('A', 'B', 'X') ELSE series IN ('EQ', 'BE') END, false) AS equity FROM series_rows)"""
ORDER_SPANS = """
order_spans AS (
  SELECT isin, 'S' || strftime(trade_date, '%Y%m%d') AS listed_symbol, trade_date AS a, CASE WHEN day(trade_date) <> 13 THEN trade_date + CAST(90 + day(trade_date) AS INTEGER) END AS b
  FROM (SELECT DISTINCT isin, trade_date FROM customer_bars WHERE day(trade_date) > 8))"""
HANDED_ON = """
handed_on AS (
  SELECT isin, venue_key, a, a + CASE WHEN k % 7 = 0 THEN 230 WHEN k % 7 = 1 THEN 150 ELSE 199 END AS b
  FROM (SELECT c_custkey AS k, 'IN' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '0' AS isin, 'K' || c_custkey % 50 AS venue_key, DATE '1992-01-01' + CAST(c_custkey // 50 * 200 AS INTEGER) AS a FROM customer)),
keyed_orders AS (SELECT 'K' || o_custkey % 50 AS venue_key, CAST(o_orderdate AS DATE) AS trade_date, o_orderkey FROM orders),
key_counts AS (
  SELECT o.venue_key, trade_date, count(h.isin) AS n, min(h.isin) AS isin
  FROM (SELECT DISTINCT venue_key, trade_date FROM keyed_orders) o LEFT JOIN handed_on h ON o.venue_key = h.venue_key AND trade_date BETWEEN a AND b GROUP BY ALL)"""
FIRST, LAST = "1995-01-02", "2001-12-31"


def entries(price_columns: str) -> dict[str, tuple]:
    """Name to (plan, extra common table expressions, select), as in the catalogue."""
    weekdays = f"(SELECT count(*) FROM (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY)) AS x) WHERE isodow(x) <= 5)"
    return {
        "day_bars": (_days, DAY_ROWS, f"SELECT * FROM ({_bars_sql('BSE', 'bse_bars')}) UNION ALL SELECT * FROM ({_bars_sql('NSE', 'nse_bars')})"),
        "day_bad_files": (lambda s, d: day_files.bad_files(_landed_days(s, d, "day_bad_files", lines=False)), MONTH_FILES, "SELECT source_id, CAST(file_day AS VARCHAR) AS day, path, error FROM file_paths WHERE error IS NOT NULL"),
        "day_files_pruned": (
            _pruned, MONTH_FILES,
            "SELECT path, 'legacy' AS version, CASE WHEN error IS NULL THEN n ELSE 0 END AS n, error FROM file_paths WHERE source_id = 'nse_bars' AND file_day >= DATE '1996-02-01' AND file_day < DATE '1997-01-01'"),
        "observed_counts": (
            _counted, COUNTED + "," + readers.ANNOUNCED,
            """SELECT 'bars' AS run, 'read' AS what, NULL AS code, count(*) AS n FROM judged_rows UNION ALL SELECT 'bars', 'kept', NULL, count(*) FROM judged_rows WHERE equity
UNION ALL SELECT 'bars', 'skipped', venue || ':' || coalesce(series, '(none)'), count(*) FROM judged_rows WHERE NOT equity GROUP BY 3
UNION ALL SELECT 'actions', 'read', NULL, count(*) FROM orders UNION ALL SELECT 'actions', 'unmatched', NULL, count(*) - (SELECT count(*) FROM terms) FROM orders
UNION ALL SELECT 'actions', 'unhandled', NULL, count(*) FROM terms WHERE action_type = 'unhandled' UNION ALL SELECT 'actions', 'kept', NULL, count(*) FROM terms WHERE action_type <> 'unhandled'
UNION ALL SELECT 'actions', 'kinds', action_type, count(*) FROM terms WHERE action_type <> 'unhandled' GROUP BY 3"""),
        "append_once": (_appended, "", "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of_date AS VARCHAR) AS as_of_date, delivery_quantity FROM delivery_daily"),
        "latest_maintained": (_maintained, "", f"SELECT {price_columns} FROM latest_price"),
        "latest_bucketed": (lambda s, d: asof.latest_price(bucketed(s, d, "latest_bucketed")[0]), "", f"SELECT {price_columns} FROM latest_price"),
        "participation_bucketed": (
            _participation, "",
            "SELECT isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(greatest(p.as_of_date, q.as_of_date) AS VARCHAR) AS as_of_date, volume, delivery_quantity, CAST((2000000 * CAST(delivery_quantity AS HUGEINT) + volume) // nullif(2 * volume, 0) AS DOUBLE) / 10000 AS delivery_pct FROM latest_price p JOIN latest_delivery q USING (isin, venue, trade_date)"),
        "registry_sync": (
            _synced, "",
            """SELECT n.source_id, tier, base_url, requests_per_second, CAST(effective_from AS VARCHAR) AS effective_from, version, CAST(effective_to AS VARCHAR) AS effective_to
FROM (SELECT n_nationkey AS k, n_name AS source_id, n_regionkey % 4 + 1 AS tier, 'https://example.org/' || n_nationkey || CASE WHEN n_nationkey % 3 = 1 THEN '/new' ELSE '' END AS base_url, CAST(c % 90 + 1 AS DOUBLE) AS requests_per_second
  FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey) n
LEFT JOIN (SELECT n_name AS source_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS effective_from, 'v' || min(l_suppkey) || CASE WHEN n_nationkey % 3 = 1 THEN 'b' ELSE '' END AS version, CAST(date_trunc('year', l_shipdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS effective_to
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 1 OR n_nationkey % 11 <> 1 AND l_shipdate >= DATE '1996-01-01' GROUP BY n_nationkey, n_name, date_trunc('year', l_shipdate)) v ON n.source_id = v.source_id"""),
        "stored_listing_merge": (
            _merged_listings, readers.CUSTOMER_LISTINGS,
            f"SELECT {readers.LISTING_TEXT.replace('scrip_code,', chr(39).join(['CASE WHEN isin < ', 'IN0000010000', ' THEN scrip_code ELSE ', 'new', ' END AS scrip_code,']))} FROM customer_listings"),
        "ordered_export": (
            _exported, "",
            "SELECT row_number() OVER (ORDER BY isin, venue, latest_price.trade_date) AS n, isin, venue, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close, CAST(previous_close AS DOUBLE) AS previous_close FROM latest_price"),
        "export_disorder": (_disorder, "", "SELECT CAST(0 * count(*) AS BIGINT) AS ordered, count(*) > 0 AS mixed FROM customer"),
        "bulk_loaded": (
            _loaded, "",
            """SELECT t AS "table", n, (SELECT count(DISTINCT (isin, trade_date)) FROM customer_bars WHERE isin NOT IN (SELECT isin FROM latest_price)) || ' rows of delivery_daily have no instrument_master' AS refused
FROM (SELECT 'instrument_master' AS t, count(DISTINCT isin) AS n FROM latest_price UNION ALL SELECT 'listing', count(*) FROM customer WHERE 'IN' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '0' IN (SELECT isin FROM latest_price)
UNION ALL SELECT 'price_daily', count(*) FROM price_daily UNION ALL SELECT 'delivery_daily', count(*) FROM delivery_daily)"""),
        "listing_matches": (
            _matches, ORDER_SPANS,
            "SELECT c.isin, CAST(trade_date AS VARCHAR) AS trade_date, count(a) AS matches, CASE WHEN count(a) = 1 THEN min(listed_symbol) END AS listed_symbol FROM (SELECT DISTINCT isin, trade_date FROM customer_bars) c LEFT JOIN order_spans o ON c.isin = o.isin AND trade_date >= a AND (b IS NULL OR trade_date <= b) GROUP BY c.isin, c.trade_date"),
        "exactly_in_force": (
            _exact, readers.CUSTOMER_LISTINGS,
            "SELECT DISTINCT c.isin, exchange AS venue, CAST(trade_date AS VARCHAR) AS trade_date, local_symbol AS listed_symbol, CAST(listing_date AS VARCHAR) AS listing_date FROM customer_bars c JOIN customer_listings l ON c.isin = l.isin WHERE delisting_date IS NULL AND trade_date >= DATE '1995-01-02'"),
        "dated_keys": (lambda s, d: _dated(s, d, 0), HANDED_ON, "SELECT o.venue_key, CAST(o.trade_date AS VARCHAR) AS trade_date, o_orderkey, isin FROM keyed_orders o JOIN key_counts c ON o.venue_key = c.venue_key AND o.trade_date = c.trade_date WHERE n = 1"),
        "dated_keys_left": (lambda s, d: _dated(s, d, 1), HANDED_ON, "SELECT venue_key, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN n = 0 THEN 'unknown' ELSE 'ambiguous' END AS reason FROM key_counts WHERE n <> 1"),
        "day_outcomes": (
            lambda s, d: day_files.outcomes(_landed_days(s, d, "day_outcomes", lines=False), FIRST, LAST), MONTH_FILES,
            f"SELECT source_id, count(*) FILTER (WHERE error IS NULL) AS published, {weekdays} - count(*) FILTER (WHERE error IS NULL OR error LIKE 'failed%') AS missing, count(*) FILTER (WHERE error LIKE 'failed%') AS failed FROM file_paths WHERE file_day BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY 1"),
    }
