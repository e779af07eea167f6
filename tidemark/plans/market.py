"""Market relations derived from the star-schema test tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def isin(key: Column) -> Column:
    return F.concat(F.lit("IN"), F.lpad(key.cast("string"), 9, "0"), F.lit("0"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return items.select(
        isin(F.col("l_suppkey")).alias("isin"), F.when(F.col("l_linestatus") == "F", "BSE").otherwise("NSE").alias("venue"), month.alias("trade_date"), F.date_add(month, F.col("l_linenumber")).alias("as_of_date"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("price"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast("decimal(20,2)").alias("value"), "l_returnflag", "l_linenumber",
    )


def price_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of suppliers by line status; the line number says when a version became known."""
    dealt = _versions(spark, sf_dir).repartition("isin", "venue")  # most groups hold one row, and windows by instrument need no second shuffle
    bars = dealt.groupBy("isin", "venue", "trade_date", "as_of_date").agg(
        F.min("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max("price").alias("close"), F.max("l_linenumber").alias("_n"),
        F.sum("quantity").alias("volume"), F.sum("value").cast("decimal(20,2)").alias("turnover"), F.count("*").alias("trade_count"),
    )
    previous = F.when(F.col("_n") % 5 == 0, F.col("close") * 2).otherwise(F.col("open")).cast("decimal(18,4)")
    return bars.select("isin", "venue", "trade_date", "as_of_date", "open", "high", "low", "close", previous.alias("previous_close"), "volume", "turnover", "trade_count")


def delivery_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).where("l_returnflag = 'N'").groupBy("isin", "venue", "trade_date", "as_of_date").agg(F.sum("quantity").alias("delivery_quantity"))


def corporate_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as actions: the priority is the type, the month the ex-date, the key the version."""
    orders = _table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("split", "bonus", "consolidation", "rights", "dividend"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    many = F.element_at(F.array(*map(F.lit, (2, 3, 7, 11))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    # Every thirteenth announcement gives no terms.
    down, paid = kind == "consolidation", (kind == "dividend") | (F.col("o_orderkey") % 13 == 0)
    return orders.select(
        isin(F.col("o_custkey")).alias("isin"), kind.alias("action_type"), month.alias("ex_date"), F.concat(F.lit("src_"), "o_orderstatus").alias("source_id"), F.date_add(month, (F.col("o_orderkey") % 28).cast("int")).alias("as_of_date"),
        F.lit("ordinary").alias("qualifier"), F.when(~paid, F.when(down, many).otherwise(F.lit(1))).cast("decimal(18,6)").alias("ratio_from"), F.when(~paid, F.when(down, F.lit(1)).otherwise(many)).cast("decimal(18,6)").alias("ratio_to"),
        F.when(kind == "dividend", F.col("o_totalprice")).cast("decimal(18,4)").alias("dividend_amount"), "o_orderkey",
    )


def adjustable_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes by customer, to meet the customers' actions."""
    joined = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keyed = joined.select(isin(F.col("o_custkey")).alias("isin"), F.lit("NSE").alias("venue"), F.col("l_shipdate").cast("date").alias("trade_date"), F.col("l_extendedprice").cast("decimal(18,4)").alias("price"))
    return keyed.groupBy("isin", "venue", "trade_date").agg(F.max("price").alias("close"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bars that carry a symbol: the user is the instrument, every third user trades on BSE under a code."""
    events = _table(spark, sf_dir, "events")
    user = F.col("user_id")
    on_bse = user % 3 == 0
    # On BSE the first day's bars carry the bare code, as files without tickers do.
    symbol = F.when(on_bse & (F.col("ts").cast("date") < F.lit("2024-01-04").cast("date")), user.cast("string")).otherwise(F.col("event_type"))
    return events.select(
        isin(user).alias("isin"), F.when(on_bse, "BSE").otherwise("NSE").alias("venue"), F.col("ts").cast("date").alias("trade_date"), "event_id", symbol.alias("local_symbol"), F.when(on_bse, user.cast("string")).alias("scrip_code"),
        F.col("value").cast("decimal(20,2)").alias("turnover"),
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the instrument master."""
    return _table(spark, sf_dir, "supplier").select(isin(F.col("s_suppkey")).alias("isin"), F.col("s_name").alias("name"))


def customer_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each order of a customer: most of their instruments are not in the master."""
    return _table(spark, sf_dir, "orders").select(isin(F.col("o_custkey")).alias("isin"), F.lit("NSE").alias("venue"), F.col("o_orderdate").cast("date").alias("trade_date"))


#: The same relations for DuckDB, as common table expressions.
SQL = """
versions AS (
  SELECT 'IN' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '0' AS isin, CASE WHEN l_linestatus = 'F' THEN 'BSE' ELSE 'NSE' END AS venue,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, CAST(date_trunc('month', l_shipdate) AS DATE) + CAST(l_linenumber AS INTEGER) AS as_of_date,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS price, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(20,2)) AS value, l_returnflag, l_linenumber
  FROM lineitem),
price_daily AS (
  SELECT isin, venue, trade_date, as_of_date, min(price) AS open, max(price) AS high, min(price) AS low, max(price) AS close,
    CAST(CASE WHEN max(l_linenumber) % 5 = 0 THEN max(price) * 2 ELSE min(price) END AS DECIMAL(18,4)) AS previous_close,
    CAST(sum(quantity) AS BIGINT) AS volume, CAST(sum(value) AS DECIMAL(20,2)) AS turnover, count(*) AS trade_count
  FROM versions GROUP BY ALL),
delivery_daily AS (
  SELECT isin, venue, trade_date, as_of_date, CAST(sum(quantity) AS BIGINT) AS delivery_quantity FROM versions WHERE l_returnflag = 'N' GROUP BY ALL),
corporate_action AS (
  SELECT isin, action_type, ex_date, source_id, as_of_date, 'ordinary' AS qualifier, o_orderkey,
    CAST(CASE WHEN action_type = 'dividend' OR o_orderkey % 13 = 0 THEN NULL WHEN action_type = 'consolidation' THEN many ELSE 1 END AS DECIMAL(18,6)) AS ratio_from,
    CAST(CASE WHEN action_type = 'dividend' OR o_orderkey % 13 = 0 THEN NULL WHEN action_type = 'consolidation' THEN 1 ELSE many END AS DECIMAL(18,6)) AS ratio_to,
    CAST(CASE WHEN action_type = 'dividend' THEN o_totalprice END AS DECIMAL(18,4)) AS dividend_amount
  FROM (SELECT 'IN' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '0' AS isin,
      list_extract(['split', 'bonus', 'consolidation', 'rights', 'dividend'], CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS action_type,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS ex_date, 'src_' || o_orderstatus AS source_id,
      CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey % 28 AS INTEGER) AS as_of_date, o_orderkey, o_totalprice, list_extract([2, 3, 7, 11], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS many
    FROM orders)),
adjustable AS (
  SELECT 'IN' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '0' AS isin, 'NSE' AS venue, CAST(l_shipdate AS DATE) AS trade_date, max(CAST(l_extendedprice AS DECIMAL(18,4))) AS close
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
observations AS (
  SELECT 'IN' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '0' AS isin, CASE WHEN user_id % 3 = 0 THEN 'BSE' ELSE 'NSE' END AS venue, CAST(ts AS DATE) AS trade_date, event_id,
    CASE WHEN user_id % 3 = 0 AND CAST(ts AS DATE) < DATE '2024-01-04' THEN CAST(user_id AS VARCHAR) ELSE event_type END AS local_symbol,
    CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS scrip_code, CAST(value AS DECIMAL(20,2)) AS turnover
  FROM events),
instruments AS (SELECT 'IN' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '0' AS isin, s_name AS name FROM supplier),
customer_bars AS (SELECT 'IN' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '0' AS isin, 'NSE' AS venue, CAST(o_orderdate AS DATE) AS trade_date FROM orders),
latest_price AS (SELECT * FROM price_daily QUALIFY row_number() OVER (PARTITION BY isin, venue, trade_date ORDER BY as_of_date DESC) = 1),
latest_delivery AS (SELECT * FROM delivery_daily QUALIFY row_number() OVER (PARTITION BY isin, venue, trade_date ORDER BY as_of_date DESC) = 1)
"""
