"""Writers: append-only facts, merges of dimensions, ordered exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quality import checked
from tidemark.schemas import TABLES


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    return [left[k].eqNullSafe(right[k]) for k in keys]


def merge(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], replace: Sequence[str]) -> DataFrame:
    """Upsert: on equal keys only the columns in ``replace`` change; new keys are added whole; nulls are equal keys.

    Incoming rows hold one row a key; their other columns count only for new keys.
    """
    news = incoming.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_n_{c}") for c in replace), F.lit(True).alias("_hit"))
    on = [existing[k].eqNullSafe(news[f"_k_{k}"]) for k in keys]
    kept = existing.join(news, on, "left").select(*(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(existing[c]).alias(c) if c in replace else existing[c] for c in existing.columns))
    return kept.unionByName(insert_only(existing, incoming, keys))


def insert_only(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key isn't there yet."""
    return incoming.join(existing.select(*keys), _same(incoming, existing, keys), "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are there stay; new keys are added."""
    return existing.unionByName(insert_only(existing, incoming, keys))


def merge_instruments(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge(existing, incoming, ["isin"], ["name"])


def merge_listings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge(existing, incoming, ["isin", "exchange", "local_symbol", "listing_date"], ["delisting_date", "closure_reason"])


def add_primary_venues(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return insert_if_absent(existing, incoming, ["isin", "effective_from", "as_of_date"])


def add_verdicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return insert_if_absent(existing, incoming, ["venue", "trade_date", "as_of_date"])


def merge_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources by id: what is known of one is replaced whole."""
    return merge(existing, incoming, ["source_id"], [c for c in incoming.columns if c != "source_id"])


def replace_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All schema versions of the incoming sources are replaced; other sources keep theirs."""
    return existing.join(incoming.select("source_id").distinct(), "source_id", "left_anti").unionByName(incoming)


def append_facts(facts: DataFrame, path: str, table: str, day: str = "trade_date") -> None:
    """Add facts to a table laid out by year; rows that break a rule fail the write. There is no update."""
    checked(facts, table).withColumn("year", F.year(day)).write.mode("append").partitionBy("year").parquet(path)


def read_facts(spark, path: str, first: str | None = None, last: str | None = None, day: str = "trade_date") -> DataFrame:
    """Facts of a range of days; the years are filtered too, so that other years' folders aren't read."""
    df = spark.read.parquet(path)
    if first:
        df = df.where((F.col(day) >= F.lit(first).cast("date")) & (F.col("year") >= int(first[:4])))
    if last:
        df = df.where((F.col(day) <= F.lit(last).cast("date")) & (F.col("year") <= int(last[:4])))
    return df.drop("year")


def save_bucketed(facts: DataFrame, name: str, buckets: int, keys: Sequence[str] = ("isin", "venue", "trade_date"), path: str | None = None) -> DataFrame:
    """Facts as a table laid out by key: hashed to ``buckets`` and sorted in each, as-of date last; the table is returned.

    Rows of one key are in one bucket, so the latest version of each is found, and tables laid out alike are joined on
    the key, without a shuffle. One file a bucket: rows are dealt by the same hash before they are written.
    With ``path`` the data lies there and what is there is replaced, also where the session's catalog doesn't know the
    table, as after a restart; without it Spark refuses a warehouse folder that it doesn't know.
    """
    write = facts.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, "as_of_date")
    (write.option("path", path) if path else write).saveAsTable(name)
    return facts.sparkSession.table(name)


def first_of_key(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The first row of each key by the order they were read in, kept in ``ordinal``."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("_at = 1").drop("_at")


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    """An ordered export with a header; nulls are empty."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


# The tables that are exported, and the order of their rows.
EXPORT_ORDER = {
    "price_daily": ("isin", "venue", "trade_date"),
    "listing": ("isin", "exchange", "local_symbol", "listing_date"),
    "corporate_action": ("isin", "ex_date", "action_type", "qualifier"),
    "delivery_daily": ("isin", "venue", "trade_date"),
    "trading_day": ("venue", "trade_date"),
    "instrument_master": ("isin",),
}
# Parents before children, as foreign keys ask.
LOAD_ORDER = ("instrument_master", "source_registry", "source_schema_version", "listing", "listing_suspension", "instrument_primary_venue", "price_daily", "delivery_daily", "corporate_action", "trading_day", "ingestion_log")


def laid_out(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table's export, in order, with its types."""
    return df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table]))


def csv_lines(df: DataFrame, table: str) -> DataFrame:
    """``line``: each row of a table's export as a line of CSV, without the header; nulls are empty."""
    return laid_out(df, table).select(line_of(table).alias("line"))


def line_of(table: str) -> Column:
    """A row of a table's export as text."""
    return F.to_csv(F.struct(*TABLES[table].names), {"nullValue": "", "emptyValue": "", "dateFormat": "yyyy-MM-dd", "quote": '"', "escape": '"'})


def parse_seed(lines: DataFrame, table: str) -> DataFrame:
    """Rows of a table from lines of its export (column ``line``); blank fields, of white space too, are null."""
    text = F.from_csv("line", ", ".join(f"{f.name} string" for f in TABLES[table]), {"quote": '"', "escape": '"'})
    return lines.select(text.alias("r")).select(*(F.nullif(F.trim(f"r.{f.name}"), F.lit("")).cast(f.dataType).alias(f.name) for f in TABLES[table]))
