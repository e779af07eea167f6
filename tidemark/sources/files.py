"""Readers of the venues' files: all text first, then a typed, canonical projection.

Every reader checks the header and names what is missing. Types are cast under ANSI rules, so one bad value
fails the read instead of turning null.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import blank_to_null, collapse_spaces, market_date, strip_zeros
from tidemark.operators.asof import first_of_group
from tidemark.operators.quality import missing_columns
from tidemark.schemas import BAR, CORPORATE_ACTION, EQUITY_SERIES

# The columns of each format, by canonical name.
UDIFF = {
    "trade_date": "TradDt", "instrument_id": "FinInstrmId", "isin": "ISIN", "symbol": "TckrSymb", "series": "SctySrs", "name": "FinInstrmNm", "open": "OpnPric", "high": "HghPric", "low": "LwPric",
    "close": "ClsPric", "previous_close": "PrvsClsgPric", "volume": "TtlTradgVol", "turnover": "TtlTrfVal", "trade_count": "TtlNbOfTxsExctd",
}
BSE_LEGACY = {
    "instrument_id": "SC_CODE", "name": "SC_NAME", "series": "SC_GROUP", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "previous_close": "PREVCLOSE", "trade_count": "NO_TRADES",
    "volume": "NO_OF_SHRS", "turnover": "NET_TURNOV", "isin": "ISIN_CODE", "trade_date": "TRADING_DATE",
}
NSE_LEGACY = {
    "symbol": "SYMBOL", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "previous_close": "PREVCLOSE", "volume": "TOTTRDQTY", "turnover": "TOTTRDVAL",
    "trade_date": "TIMESTAMP", "trade_count": "TOTALTRADES", "isin": "ISIN",
}
NSE_DELIVERY = ("SYMBOL", "SERIES", "DATE1", "TTL_TRD_QNTY", "DELIV_QTY")
BSE_DELIVERY = ("DATE", "SCRIP CODE", "DELIVERY QTY")
ACTION_FIELDS = ("scrip_code", "Purpose", "exdate")
NOT_DELIVERABLE = "-"


class SchemaDrift(ValueError):
    """A file without what its format promises."""


class SourceUnavailable(ValueError):
    """An archive that can't be read."""


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A headed CSV, all text; a byte order mark is dropped."""
    settings = {"header": True, "inferSchema": False, "enforceSchema": False, "quote": '"', "escape": '"', "encoding": "UTF-8"} | options
    df = spark.read.options(**settings).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def _required(df: DataFrame, columns, what: str) -> None:
    if missing := missing_columns(df, columns):
        raise SchemaDrift(f"{what} is missing {missing}")


def _bars(df: DataFrame, columns: dict[str, str], what: str, trade_date: Column, **fixed: Column) -> DataFrame:
    _required(df, columns.values(), what)
    number = {f.name: f.dataType for f in BAR if f.name in ("open", "high", "low", "close", "previous_close", "volume", "turnover", "trade_count")}
    of = lambda name: F.col(f"`{columns[name]}`")
    optional = ("previous_close", "turnover", "trade_count")
    picked = [((blank_to_null(of(n)) if n in optional else F.trim(of(n))).cast(t)).alias(n) for n, t in number.items()]
    return df.select(trade_date.alias("trade_date"), *(c.alias(n) for n, c in fixed.items()), *picked)


def parse_udiff(raw: DataFrame) -> DataFrame:
    """The common format of both venues; header names must match as they are."""
    if missing := sorted(set(UDIFF.values()) - set(raw.columns)):
        raise SchemaDrift(f"the file is missing {missing}")
    text = {n: F.col(UDIFF[n]) for n in ("isin", "symbol", "instrument_id", "series")}
    return _bars(raw, UDIFF, "the file", F.to_date(F.col(UDIFF["trade_date"])), **text, name=F.trim(UDIFF["name"]))


def parse_bse_legacy(raw: DataFrame) -> DataFrame:
    """The old format of BSE: no ticker, so the code is the symbol; padded text is trimmed."""
    of = lambda n: F.trim(F.col(BSE_LEGACY[n]))
    return _bars(raw, BSE_LEGACY, "the old BSE file", market_date(F.col(BSE_LEGACY["trade_date"]), "dd-MMM-yy"), isin=of("isin"), symbol=of("instrument_id"), instrument_id=of("instrument_id"), series=of("series"), name=of("name"))


def parse_nse_legacy(raw: DataFrame) -> DataFrame:
    """The old format of NSE: no code and no name, so the symbol is the name; months may be upper-case."""
    day = market_date(F.initcap(F.col(NSE_LEGACY["trade_date"])), "dd-MMM-yyyy")
    return _bars(raw, NSE_LEGACY, "the old NSE file", day, isin=F.col(NSE_LEGACY["isin"]), symbol=F.col(NSE_LEGACY["symbol"]), instrument_id=F.lit(None).cast("string"), series=F.col(NSE_LEGACY["series"]), name=F.col(NSE_LEGACY["symbol"]))


def equity_only(rows: DataFrame, venue: str) -> DataFrame:
    return rows.where(F.col("series").isin(*EQUITY_SERIES[venue]))


def skipped_series(rows: DataFrame, venue: str) -> DataFrame:
    """Rows by series that are not equity there; unknown series count too."""
    return rows.where(F.col("series").isNull() | ~F.col("series").isin(*EQUITY_SERIES[venue])).groupBy("series").agg(F.count("*").alias("n"))


def normalize_bars(rows: DataFrame, venue: str) -> DataFrame:
    """Canonical bars of a venue's equity; the code counts on BSE alone, and a bar is known on its day."""
    code = F.col("instrument_id") if venue == "BSE" else F.lit(None).cast("string")
    bars = equity_only(rows, venue).select("*", F.lit(venue).alias("venue"), F.col("trade_date").alias("as_of_date"), F.col("symbol").alias("local_symbol"), code.alias("scrip_code"))
    return bars.select(*(F.col(f.name).cast(f.dataType) for f in BAR))


def parse_nse_delivery(raw: DataFrame) -> DataFrame:
    """(venue_key, trade_date, delivery_quantity); names and values are padded, a dash means none is deliverable."""
    _required(raw, NSE_DELIVERY, "the NSE delivery file")
    trimmed = raw.toDF(*(c.strip() for c in raw.columns)).select(*(F.trim(F.col(c)).alias(c) for c in NSE_DELIVERY))
    return trimmed.where(F.col("DELIV_QTY") != NOT_DELIVERABLE).select(F.col("SYMBOL").alias("venue_key"), market_date(F.initcap("DATE1"), "dd-MMM-yyyy").alias("trade_date"), F.col("DELIV_QTY").cast("long").alias("delivery_quantity"))


def parse_bse_delivery(lines: DataFrame, header: str) -> DataFrame:
    """The same from pipe-delimited lines (column ``value``); blank and short lines are skipped, zeros in front dropped."""
    names = [n.strip() for n in header.lstrip("﻿").split("|")]
    if missing := sorted(set(BSE_DELIVERY) - set(names)):
        raise SchemaDrift(f"the BSE delivery file is missing {missing}")
    parts = F.split(F.regexp_replace("value", "[\r\n﻿]", ""), r"\|")
    of = lambda n: F.trim(F.get("p", F.lit(names.index(n))))
    rows = lines.select(parts.alias("p"), F.trim("value").alias("v")).where((F.col("v") != "") & (F.size("p") >= len(names)) & (of("DATE") != "DATE"))
    return rows.select(strip_zeros(of("SCRIP CODE")).alias("venue_key"), market_date(of("DATE"), "ddMMyyyy").alias("trade_date"), of("DELIVERY QTY").cast("long").alias("delivery_quantity"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Corporate actions from files that each hold an array of objects; codes are numbers there and text here.

    Missing fields are found in the data, record by record, since a reader with a schema would make them null.
    """
    return parse_actions(spark.read.text(path, wholetext=True))


def parse_actions(raw: DataFrame) -> DataFrame:
    """The records of payloads (column ``value``), as in ``read_actions``; ``ordinal`` is a record's place in its payload."""
    items = F.from_json("value", "array<map<string,string>>", {"mode": "PERMISSIVE"})
    opened = raw.select(F.when(F.ltrim("value").startswith("["), items).alias("items"))
    listed = F.when(F.col("items").isNull(), F.raise_error(F.lit("the corporate-action payload is no list of records"))).otherwise(F.col("items"))
    absent = lambda r: F.concat_ws(", ", *(F.when(~F.map_contains_key(r, n), n) for n in sorted(ACTION_FIELDS)))
    whole = lambda r: F.when(absent(r) == "", r).otherwise(F.raise_error(F.concat(F.lit("a corporate action is missing "), absent(r))))
    # The list is checked before it is opened, so that later steps read plain columns.
    rows = opened.select(F.posexplode(F.transform(listed, whole)).alias("ordinal", "r"))
    return rows.select("ordinal", *(F.try_element_at("r", F.lit(n)).alias(c) for n, c in (("scrip_code", "scrip_code"), ("Purpose", "purpose"), ("exdate", "exdate"))))


def parse_purpose(text: Column) -> Column:
    """Struct (action_type, qualifier, ratio_from, ratio_to, dividend_amount) of an announcement's purpose.

    ``bonus issue a:b`` gives a for b held; ``stock split from Rs x to Rs y`` is a consolidation where the face value
    rises; a dividend's amount may stand anywhere, its kind only in front. Anything else is ``unhandled``.
    """
    t = collapse_spaces(text)
    dec = "decimal(38,18)"
    bonus, split = r"(?i)^bonus issue\s+(\d+)\s*:\s*(\d+)", r"(?i)^stock\s+split\s+from\s+rs\.?\s*([\d.]+)\s*/?-?\s*to\s+rs\.?\s*([\d.]+)"
    dividend, kind = r"(?i)dividend\s*-\s*rs\.?\s*-\s*([\d.]+)", r"(?i)^(interim|final|special)\s+dividend"
    part = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast(dec)
    none = F.lit(None).cast(dec)
    old, new = part(split, 1), part(split, 2)
    row = lambda a, q, x, y, d: F.struct(F.lit(a).alias("action_type"), q.alias("qualifier"), x.cast(dec).alias("ratio_from"), y.cast(dec).alias("ratio_to"), d.cast(dec).alias("dividend_amount"))
    plain = F.lit("ordinary")
    return (
        F.when(t.rlike(bonus), row("bonus", plain, part(bonus, 2), part(bonus, 1) + part(bonus, 2), none))
        .when(t.rlike(split) & (new > old), row("consolidation", plain, new / old, F.lit(1), none))
        .when(t.rlike(split), row("split", plain, F.lit(1), F.when(new <= 0, F.raise_error(F.concat(F.lit("split to a face value of 0: "), t)).cast(dec)).otherwise(old / F.nullif(new, F.lit(0))), none))
        .when(t.rlike(dividend), row("dividend", F.coalesce(F.nullif(F.lower(F.regexp_extract(t, kind, 1)), F.lit("")), plain), none, none, part(dividend, 1)))
        .otherwise(row("unhandled", plain, none, none, none))
    )


def normalize_actions(rows: DataFrame, scrips: DataFrame, as_of: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """(actions, rows whose terms the text doesn't give) of known scrips; of equal keys the first in the file stays."""
    parsed = rows.join(scrips.select("scrip_code", "isin"), "scrip_code").withColumn("a", parse_purpose(F.col("purpose")))
    unhandled = parsed.where("a.action_type = 'unhandled'").select("isin", "purpose", "exdate")
    return dated_actions(parsed.where("a.action_type <> 'unhandled'"), as_of, source_id), unhandled


def dated_actions(parsed: DataFrame, as_of: str, source_id: str) -> DataFrame:
    """Corporate actions of records with ``isin`` and their terms ``a``; of equal keys the first in the file stays."""
    known = parsed.select("isin", "ordinal", "a.*", F.to_date("exdate", "yyyyMMdd").alias("ex_date"))
    w = Window.partitionBy("isin", "action_type", "ex_date", "qualifier").orderBy("ordinal")
    first = known.withColumn("_at", F.row_number().over(w)).where("_at = 1")
    dated = first.withColumn("as_of_date", F.lit(as_of).cast("date")).withColumn("source_id", F.lit(source_id))
    return dated.select(*(F.col(f.name).cast(f.dataType) for f in CORPORATE_ACTION))


def bse_scrips(listings: DataFrame) -> DataFrame:
    """The instrument behind each code of the listings on BSE; of several the one listed last."""
    coded = listings.where("exchange = 'BSE' AND scrip_code IS NOT NULL")
    return first_of_group(coded, ["scrip_code"], F.col("listing_date").desc(), F.col("isin").desc()).select("scrip_code", "isin")


def unzip_each(files: DataFrame, suffix: str | None = None) -> DataFrame:
    """(path, name, content, error) of archives that should hold exactly one entry (ending in ``suffix``, if given).

    An archive that can't be read, or holds another number of entries, is a row with ``error`` alone, so the rest of
    a job goes on. Spark has no zip codec, so each file is opened in a task; a file is a row, and no row meets another.
    """

    def opened(path: str, content: bytes) -> tuple:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                names = [n for n in z.namelist() if suffix is None or n.lower().endswith(suffix)]
                return (path, names[0], z.read(names[0]), None) if len(names) == 1 else (path, None, None, f"{path} holds {len(names)} entries where one is expected")
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
            return path, None, None, f"{path} is no archive: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([opened(*row) for row in zip(batch["path"], batch["content"])], columns=["path", "name", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary, error string")


def unzip(files: DataFrame, suffix: str | None = None) -> DataFrame:
    """(path, name, content) of archives of one entry; one that isn't fails the read."""
    whole = F.col("error").isNull() | F.raise_error(F.col("error")).isNotNull()
    return unzip_each(files, suffix).where(whole).drop("error")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, at, value): the lines of text contents, numbered from 0; line ends and a byte order mark are dropped."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    return files.select("path", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("at", "value"))


def csv_of(lines: DataFrame, header: str) -> DataFrame:
    """Lines (column ``value``) that follow a header, as text columns of its names; the header itself and blank lines go."""
    names = header.lstrip("\ufeff").split(",")
    parsed = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"quote": '"', "escape": '"'})
    return lines.where((F.trim("value") != "") & (F.col("value") != header)).select(parsed.alias("r")).select("r.*")


#: The parser of each venue and schema version.
PARSERS = {("BSE", "udiff"): parse_udiff, ("NSE", "udiff"): parse_udiff, ("BSE", "legacy"): parse_bse_legacy, ("NSE", "legacy"): parse_nse_legacy}


def read_rows(raw: DataFrame, venue: str, version: str) -> DataFrame:
    """Canonical bars of raw rows of one venue and schema version: parse, then normalize."""
    if (venue, version) not in PARSERS:
        raise SchemaDrift(f"no parser for {version} of {venue}")
    return normalize_bars(PARSERS[venue, version](raw), venue)


def read_day(spark: SparkSession, path: str, venue: str, version: str | None) -> DataFrame:
    """Canonical bars of a day's file, plain or zipped, in the schema version in force that day; none in force is an error.

    The header is the file's first line. A zipped file is opened in a task and its lines are split there.
    """
    if version is None:
        raise SchemaDrift(f"no schema version of {venue} is in force for {path}")
    if not path.endswith(".zip"):
        return read_rows(read_csv(spark, path), venue, version)
    lines = lines_of(unzip(spark.read.format("binaryFile").load(path), ".csv"))
    return read_rows(csv_of(lines, lines.where("at = 0").first()["value"]), venue, version)


def read_bse_delivery(spark: SparkSession, path: str) -> DataFrame:
    """Delivered quantities of a zipped BSE file: its one entry's lines, the first of which is the header."""
    lines = lines_of(unzip(spark.read.format("binaryFile").load(path)))
    return parse_bse_delivery(lines.where("at > 0").select("value"), lines.where("at = 0").first()["value"])


def concatenate(*parts: DataFrame) -> DataFrame:
    """The rows of several adapters, days or venues, by column name."""
    return reduce(DataFrame.unionByName, parts)


def not_error_pages(files: DataFrame) -> DataFrame:
    """Landed files that aren't a web page: those whose first byte other than white space isn't ``<``."""
    head = F.ltrim(F.regexp_replace(F.decode(F.substring("content", 1, 256), "ISO-8859-1"), r"^\s+", ""))
    return files.where(~F.startswith(head, F.lit("<")))


def landed(spark: SparkSession, root: str, source: str, glob: str = "*") -> DataFrame:
    """Files of a source in the landing folder, as ``path`` and ``content``; zips stay zipped."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root}/{source}")
