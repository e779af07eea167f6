"""Exports as one ordered text in numbered parts, the reader that proves their order, and the bulk load of a folder of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.schemas import TABLES
from tidemark.sources.sinks import EXPORT_ORDER, LOAD_ORDER, laid_out, line_of
from tidemark.sources.snapshots import FACT_KEYS, RepeatedKeys, Store


class ForeignKeyViolation(ValueError):
    """Rows that refer to a parent that isn't there."""


class ColumnMismatch(ValueError):
    """A header that names columns that the table doesn't have."""


def export_ordered(df: DataFrame, table: str, path: str) -> None:
    """A table's export as one text: its header, then its rows in its fixed order, nulls first.

    The order is global: rows are dealt to ranges and sorted there, and part files are numbered by range, so that
    the parts one after the other are the whole file. The header is the least row, hence in the first part alone.
    A field with a line end is an error, since a line is a row.
    """
    keys = EXPORT_ORDER[table]
    rows = laid_out(df, table)
    texts = [F.coalesce(f.name, F.lit("")) for f in TABLES[table] if f.dataType.simpleString() == "string"]
    broken = F.concat(*texts).rlike("[\r\n]") if texts else F.lit(False)
    line = F.when(broken, F.raise_error(F.lit(f"{table}: a field holds a line end"))).otherwise(line_of(table))
    body = rows.select(F.lit(1).alias("_h"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), line.alias("value"))
    head = df.sparkSession.createDataFrame([(",".join(TABLES[table].names),)], "value string").select(F.lit(0).alias("_h"), *(F.lit(None).cast(TABLES[table][k].dataType).alias(f"_k{i}") for i, k in enumerate(keys)), "value")
    order = [F.col(f"_k{i}").asc_nulls_first() for i in range(len(keys))]
    head.unionByName(body).orderBy("_h", *order, "value").select("value").write.mode("overwrite").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``part`` (the file's name) and ``line`` (its place in the part from 0) of a folder of text parts.

    Blocks of a part that were read apart are put back in order by where they start.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return read.select("value", "part", (F.row_number().over(Window.partitionBy("part").orderBy("_block", "_id")) - 1).cast("long").alias("line"))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The columns that a text, or the first part of a folder of them, names in its first line; none if there is no line."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(str(s.getPath()) for s in store.listStatus(place) if s.getLen() and not s.getPath().getName().startswith(("_", ".")))
    first = spark.read.text(files[0]).first() if files else None
    return [n.strip() for n in first.value.lstrip("﻿").split(",")] if first else []


def read_text_table(lines: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Typed rows of CSV lines (column ``value``, others are kept) with ``columns``; blank fields are null, those not named too.

    The header and blank lines go; a line with too few fields, or a value of another type, fails the read.
    """
    if unknown := sorted(set(columns) - set(TABLES[table].names)):
        raise ColumnMismatch(f"{table} has no columns {unknown}")
    text = F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"quote": '"', "escape": '"', "mode": "FAILFAST"})
    others = [c for c in lines.columns if c != "value"]
    kept = lines.where((F.trim("value") != "") & (F.replace(F.ltrim("value", F.lit("﻿")), F.lit(" "), F.lit("")) != ",".join(columns)))
    fields = [(F.nullif(F.trim(f"_r.{f.name}"), F.lit("")) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]]
    return kept.select(*others, text.alias("_r")).select(*others, *fields)


def read_export(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of an ordered export with ``part`` and ``line``."""
    return read_text_table(numbered_lines(spark, path), table, header_of(spark, path))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (part, line) with ``n``, their place in the whole text: lines of the parts before are added, one number a part."""
    last = rows.groupBy("part").agg(F.max("line").alias("_last"))
    before = last.select("part", F.coalesce(F.sum(F.col("_last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "part").withColumn("n", F.col("line") + F.col("_before")).drop("_before")


def disorder(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (part, line) whose key is under that of the row before: in their part, or at the end of the part before. None in an ordered export."""
    key = F.struct(*keys)
    within = rows.withColumn("_before", F.lag(key).over(Window.partitionBy("part").orderBy("line")))
    ends = rows.groupBy("part").agg(F.max_by(key, "line").alias("_end"))
    border = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = ends.select("part", F.last("_end").over(border).alias("_border"))
    joined = within.join(across, "part").withColumn("_before", F.coalesce("_before", "_border"))
    return joined.where(F.col("_before") > key).drop("_before", "_border")


# What each table's rows refer to, as (columns, parent, its columns), and what tells the rows of a dimension apart.
FOREIGN_KEYS = {
    "listing": (("isin",), "instrument_master", ("isin",)), "listing_suspension": (("isin", "exchange"), "listing", ("isin", "exchange")), "instrument_primary_venue": (("isin",), "instrument_master", ("isin",)),
    "price_daily": (("isin",), "instrument_master", ("isin",)), "delivery_daily": (("isin",), "instrument_master", ("isin",)), "corporate_action": (("isin",), "instrument_master", ("isin",)),
    "source_schema_version": (("source_id",), "source_registry", ("source_id",)),
}
PRIMARY_KEYS = FACT_KEYS | {
    "instrument_master": ("isin",), "listing": ("isin", "exchange", "local_symbol", "listing_date"), "listing_suspension": ("isin", "exchange", "suspended_from", "as_of_date"),
    "instrument_primary_venue": ("isin", "effective_from", "as_of_date"), "source_registry": ("source_id",), "source_schema_version": ("source_id", "effective_from"),
}


def orphan_keys(child: DataFrame, parents: Sequence[DataFrame], columns: Sequence[str], parent_columns: Sequence[str]) -> DataFrame:
    """Keys of ``child`` that no parent has, with their ``n`` rows; a key with a null refers to nothing.

    Rows are counted by key before they meet the parents, so a key with very many rows is one row there.
    """
    keys = child.groupBy(*columns).agg(F.count("*").alias("n")).dropna(subset=list(columns))
    for p in parents:
        keys = keys.join(p.select(*(F.col(c).alias(k) for c, k in zip(parent_columns, columns))), list(columns), "left_anti")
    return keys


def bulk_load(spark: SparkSession, folder: str, root: str) -> dict[str, int]:
    """Load ``<table>.csv`` (a file, or a folder of ordered parts) of each table in ``folder`` into the stores below ``root``.

    Parents come before children. Of each table the header names the columns; its rows must meet its rules, have keys
    that are neither there nor repeated, and refer to parents that are there or come with the load. All tables are
    written aside and checked before the first is committed, so a load that fails changes none. Tables without a file
    are left out; the versions committed are returned.
    """
    store = {t: Store(spark, f"{root}/{t}") for t in LOAD_ORDER}
    base = {t: s.version() for t, s in store.items()}
    staged: dict[str, dict[str, list[str]]] = {}
    there = {t: store[t].read(base[t], schema=TABLES[t]) for t in LOAD_ORDER}
    come: dict[str, DataFrame] = {}
    for table in LOAD_ORDER:
        path = f"{folder}/{table}.csv"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            continue
        rows = read_text_table(spark.read.text(path).select("value"), table, header_of(spark, path))
        staged[table] = store[table].stage(quality.checked(rows, table), _part(table))
        come[table] = spark.read.schema(TABLES[table]).parquet(*(f"{store[table].root}/{f}" for fs in staged[table].values() for f in fs)) if staged[table] else spark.createDataFrame([], TABLES[table])
        if keys := PRIMARY_KEYS.get(table):
            every = come[table].select(*keys).unionByName(there[table].select(*keys).join(come[table].select(*keys).distinct(), list(keys), "left_semi"))
            if again := quality.duplicates(every, *keys).orderBy(*keys).limit(5).collect():
                raise RepeatedKeys(f"{table} repeats keys such as {[tuple(map(str, r[:-1])) for r in again]}")
        if table in FOREIGN_KEYS:
            columns, parent, parent_columns = FOREIGN_KEYS[table]
            lost = orphan_keys(come[table], [x[parent] for x in (there, come) if parent in x], columns, parent_columns)
            n = lost.agg(F.sum("n")).first()[0]
            if n:
                raise ForeignKeyViolation(f"{n} rows of {table} have no {parent}: {[tuple(map(str, r[:-1])) for r in lost.orderBy(*columns).limit(5).collect()]}")
    out = {}
    for table, parts in staged.items():
        held = store[table].manifest(base[table])["parts"]
        out[table] = store[table].commit({p: held.get(p, []) + parts.get(p, []) for p in sorted({*held, *parts})}, TABLES[table], base[table])
    return out


def _part(table: str) -> Column | None:
    if table not in FACT_KEYS:
        return None
    return F.year("ex_date" if table == "corporate_action" else "trade_date").cast("string")
