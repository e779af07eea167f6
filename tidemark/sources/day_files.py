"""Many landed day files in one scan, and the writer that lands them.

A landing folder holds ``<source>/<yyyyMMdd...><suffix>``, one file for a source and day, plain or zipped. ``day_files``
is a data source whose partitions are packs of such files: each file is opened in a task, read in the layout that was
in force on its day, and given out as text columns under one set of names. What can't be read comes out as a row with
``error``, so one bad file neither ends the job nor is lost. Filters on the day or the source drop files before any is
opened. ``landing`` is the sink that files arrive through, ``landing_pieces`` the one for files too long to be a row.

A file is read and written in blocks, so a worker holds a few of them however long the file is.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tidemark.functions.scalars import blank_to_null, market_date
from tidemark.schemas import BAR, EQUITY_SERIES
from tidemark.sources.files import BSE_LEGACY, NSE_LEGACY, UDIFF, not_error_pages

LAYOUTS = {("BSE", "udiff"): UDIFF, ("NSE", "udiff"): UDIFF, ("BSE", "legacy"): BSE_LEGACY, ("NSE", "legacy"): NSE_LEGACY}
TEXT = tuple(UDIFF)
SCHEMA = "source_id string, venue string, day date, version string, path string, at long, error string, " + ", ".join(f"{c} string" for c in TEXT)
#: Bytes and files of one partition of the scan.
PACK_BYTES, PACK_FILES = 32 << 20, 64
#: Bytes of text that are parsed at once, and rows that are given out at once.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 10_000
#: What an archive that can't be read raises, when it is opened or later.
BROKEN = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError)


class Unreadable(ValueError):
    """Why a file gives no rows: ``not published`` or ``failed``, and the reason."""


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


@contextmanager
def text_of(store: pyarrow.fs.FileSystem, path: str) -> Iterator:
    """A file's text as a stream: as it is, or the one entry of its archive that ends in ``.csv``; a web page is no file."""
    file = store.open_input_file(path)
    try:
        if file.read(256).lstrip()[:1] == b"<":
            raise Unreadable("not published: a web page")
        file.seek(0)
        text = file
        if path.lower().endswith(".zip"):
            try:
                archive = zipfile.ZipFile(file)
                entries = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                if len(entries) != 1:
                    raise Unreadable(f"failed: {len(entries)} entries where one is expected")
                text = archive.open(entries[0])
            except (*BROKEN, pa.ArrowInvalid) as e:  # Arrow's word for a place before the start
                raise Unreadable("failed: no archive") from e
        yield text
    finally:
        file.close()


def blocks_of(store: pyarrow.fs.FileSystem, path: str, venue: str, version: str | None) -> Iterator[pa.RecordBatch]:
    """A file's rows as text under the common names, block by block; names of the old layouts may be padded, those of the new may not."""
    with text_of(store, path) as file:
        columns = LAYOUTS.get((venue, version))
        if columns is None:
            raise Unreadable("failed: no schema version in force")
    how = pa.csv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES)
    try:
        with text_of(store, path) as file:
            head = pa.csv.open_csv(file, how).schema.names
        found = {n if version == "udiff" else n.strip(): n for n in head}
        if missing := sorted(set(columns.values()) - set(found)):
            raise Unreadable(f"failed: columns are missing: {', '.join(missing)}")
        kinds = pa.csv.ConvertOptions(column_types={n: pa.string() for n in head}, strings_can_be_null=False)
        with text_of(store, path) as file:
            for block in pa.csv.open_csv(file, how, convert_options=kinds):
                none = pa.nulls(block.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([block.column(found[columns[c]]) if c in columns else none for c in TEXT], list(TEXT))
    except pa.ArrowInvalid as e:
        raise Unreadable(f"failed: {str(e).splitlines()[0]}") from e
    except BROKEN as e:
        raise Unreadable("failed: no archive" if path.lower().endswith(".zip") else "failed: can't be read") from e


class DayFile(InputPartition):
    """A pack of (source, venue, day, version, path)."""


class DayFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.venues = json.loads(options["venues"])
        self.spans = [(s, date.fromisoformat(a), date.fromisoformat(b or "9999-12-31"), v) for s, a, b, v in json.loads(options["versions"])]
        self.lines = options.get("lines", "true") == "true"
        self.tests = []

    def pushFilters(self, filters):
        """Files are dropped by their day and source; Spark applies all filters again."""
        ranges = {EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
        for f in filters:
            if type(f) in ranges and f.attribute in (("day",), ("source_id",), ("venue",)):
                self.tests.append((f.attribute[0], ranges[type(f)], f.value))
            yield f

    def version(self, source: str, day: date) -> str | None:
        """The first version by start whose span holds the day, both ends included."""
        return min(((a, v) for s, a, b, v in self.spans if s == source and a <= day <= b), default=(None, None))[1]

    def partitions(self):
        files, sizes = [], []
        store, root = _store(self.root)
        for source, venue in sorted(self.venues.items()):
            for info in sorted(store.get_file_info(pyarrow.fs.FileSelector(f"{root}/{source}", allow_not_found=True)), key=lambda i: i.path):
                stem = re.match(r"\d{8}", info.base_name)
                try:
                    day = date.fromisoformat(stem[0]) if stem else None
                except ValueError:
                    day = None
                known = {"day": day, "source_id": source, "venue": venue}
                if info.is_file and not info.base_name.startswith((".", "_")) and all(known[n] is not None and test(known[n], v) for n, test, v in self.tests):
                    files.append((source, venue, day, self.version(source, day) if day else None, info.path))
                    sizes.append(info.size or 0)
        packs, size = [], PACK_BYTES
        for file, n in zip(files, sizes):
            if size + n > PACK_BYTES or len(packs[-1]) >= PACK_FILES:
                packs.append([])
                size = 0
            packs[-1].append(file)
            size += n
        return [DayFile(p) for p in packs] or [DayFile([])]

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        """Each file is read to its end before any of its rows are given out, since a bad one gives none, and then once more."""
        store, _ = _store(self.root)
        for source, venue, day, version, path in partition.value:
            error, n = None, 0
            try:
                if day is None:
                    raise Unreadable("failed: no day in the name")
                n = sum(b.num_rows for b in blocks_of(store, path, venue, version))
            except Unreadable as e:
                error = str(e)
            same = {"source_id": pa.scalar(source), "venue": pa.scalar(venue), "day": pa.scalar(day, pa.date32()), "version": pa.scalar(version, pa.string()), "path": pa.scalar(f"{source}/{path.rsplit('/', 1)[-1]}")}

            def placed(block: pa.RecordBatch, at: pa.Array) -> pa.RecordBatch:
                lead = {k: pa.repeat(v, block.num_rows) for k, v in same.items()} | {"at": at, "error": pa.repeat(pa.scalar(error, pa.string()), block.num_rows)}
                return pa.RecordBatch.from_arrays([*lead.values(), *block.columns], [*lead, *TEXT])

            if error is not None or not n or not self.lines:  # a file without rows is still a file
                yield placed(pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()) for _ in TEXT], list(TEXT)), pa.nulls(1, pa.int64()))
                continue
            done = 0
            for block in blocks_of(store, path, venue, version):
                for i in range(0, block.num_rows, BLOCK_ROWS):
                    part = block.slice(i, BLOCK_ROWS)
                    yield placed(part, pa.array(range(done + 1, done + part.num_rows + 1), pa.int64()))
                    done += part.num_rows


class DayFiles(DataSource):
    """``spark.read.format("day_files")``: options ``path``, ``venues`` and ``versions`` (both JSON), ``lines`` (false: one row a file)."""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DayFileReader(self.options)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(source_id, partition, suffix, entry, content) of each run of rows of one entry in a batch; their contents are joined."""
    for batch in batches:
        *keys, content = batch.columns
        changed = np.zeros(max(batch.num_rows - 1, 0), bool)
        for k in keys:
            k = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            changed |= k[1:] != k[:-1]
        ends = [*(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for i, j in zip([0, *ends], ends):
            if i < j:
                part = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), content.slice(i, j - i))
                yield *(k[i].as_py() for k in keys), pc.binary_join(part, b"")[0].as_py()


class LandingWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Each file under a name of its own, then moved into place; one that is there stays as it is."""
        store, root = _store(self.root)
        for batch in iterator:
            for i in range(batch.num_rows):  # one content at a time
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                folder, name = f"{root}/{row['source_id']}", f"{row['partition']}{row['suffix']}"
                if store.get_file_info(f"{folder}/{name}").type != pyarrow.fs.FileType.NotFound:
                    continue
                store.create_dir(folder)
                aside = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as f:
                    f.write(row["content"] or b"")
                store.move(aside, f"{folder}/{name}")
        return WriterCommitMessage()


class Landing(DataSource):
    """``df.write.format("landing")``: rows of (source_id, partition, suffix, content) as files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "source_id string, partition string, suffix string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("landed files are kept: write in append mode")
        return LandingWriter(self.options["path"])


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Pieces of a file follow each other and go to its end as they come; a file that is there stays as it is."""
        store, root = _store(self.root)
        for (source, partition, suffix), pieces in groupby(_runs(iterator), lambda run: run[:3]):
            folder, name = f"{root}/{source}", f"{partition}{suffix}"
            if store.get_file_info(f"{folder}/{name}").type != pyarrow.fs.FileType.NotFound:
                continue
            store.create_dir(folder)
            aside = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(aside, buffer_size=BLOCK_BYTES) as file:
                z = None
                for entry, parts in groupby(pieces, lambda run: run[3]):
                    if entry is None:
                        file.writelines(run[4] for run in parts)
                        continue
                    z = z or zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                    with z.open(entry, "w", force_zip64=True) as held:
                        held.writelines(run[4] for run in parts)
                if z:
                    z.close()
            store.move(aside, f"{folder}/{name}")
        return WriterCommitMessage()


class LandingPieces(Landing):
    """``df.write.format("landing_pieces")``: rows of (source_id, partition, suffix, entry, content), those of a file one after the other."""

    @classmethod
    def name(cls) -> str:
        return "landing_pieces"

    def schema(self) -> str:
        return "source_id string, partition string, suffix string, entry string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("landed files are kept: write in append mode")
        return PieceWriter(self.options["path"])


def land_pieces(pieces: DataFrame, root: str) -> None:
    """Write files that come as pieces: (source_id, partition, suffix, entry, at, content), ordered by ``at`` and content.

    A piece with an ``entry`` is part of that entry of an archive, one without is part of the file itself. A file is
    written by one task, which sorts its pieces and holds a batch of them; no content is gathered. Null contents are empty.
    """
    spark, file = pieces.sparkSession, ("source_id", "partition", "suffix")
    spark.dataSource.register(LandingPieces)
    dealt = pieces.repartition(*file).sortWithinPartitions(*file, "entry", "at", "content")
    dealt.select(*file, "entry", F.coalesce("content", F.lit(b"")).alias("content")).write.format("landing_pieces").option("path", root).mode("append").save()


def land(files: DataFrame, root: str, pages: bool = False) -> None:
    """Write (source_id, partition, suffix, content) as files of the landing folder ``root``.

    A file that is there is not written again: a past day's file does not change. Web pages are left out, unless
    ``pages`` says otherwise. A repeated name lands once; a null content is an empty file.
    """
    spark = files.sparkSession
    spark.dataSource.register(Landing)
    whole = files.select("source_id", "partition", "suffix", F.coalesce("content", F.lit(b"")).alias("content"))
    once = whole if pages else not_error_pages(whole)
    once.write.format("landing").option("path", root).mode("append").save()


def scan_days(spark: SparkSession, root: str, venues: dict[str, str], versions: DataFrame, lines: bool = True) -> DataFrame:
    """Every row of every day file below ``root`` as text, and a row with ``error`` for each file that can't be read.

    ``venues`` names the sources to read and the venue of each; ``versions`` (source_id, effective_from, version,
    effective_to) is the registry's few rows. ``at`` is a row's place in its file from 1, null where a file gave none.
    Without ``lines`` every file is one row, read to its end all the same: enough for ``bad_files`` and ``outcomes``.
    """
    spark.dataSource.register(DayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spans = [(r.source_id, str(r.effective_from), r.effective_to and str(r.effective_to), r.version) for r in versions.where(F.col("source_id").isin(*venues)).collect()]
    return spark.read.format("day_files").option("path", root).option("venues", json.dumps(venues)).option("versions", json.dumps(spans)).option("lines", str(lines).lower()).load()


def equity_of_venue() -> Column:
    """Whether a row's series is equity at its own venue; an unknown venue has none."""
    return F.coalesce(*(F.when(F.col("venue") == v, F.col("series").isin(*s)) for v, s in EQUITY_SERIES.items()), F.lit(False))


def typed(rows: DataFrame) -> DataFrame:
    """Canonical bars of scanned rows of any venue and version, with ``day`` and ``series``: one projection for all layouts.

    Types are cast under ANSI rules, so one bad value fails the read. Rows with ``error`` give none.
    """
    new, bse = F.col("version") == "udiff", F.col("venue") == "BSE"
    text = lambda c: F.when(~new & bse, F.trim(c)).otherwise(F.col(c))
    day = F.when(new, F.to_date("trade_date")).when(bse, market_date(F.col("trade_date"), "dd-MMM-yy")).otherwise(market_date(F.initcap("trade_date"), "dd-MMM-yyyy"))
    optional = ("previous_close", "turnover", "trade_count")
    number = {f.name: (blank_to_null(F.col(f.name)) if f.name in optional else F.trim(f.name)).cast(f.dataType) for f in BAR if f.name in ("open", "high", "low", "close", "volume", *optional)}
    columns = number | {
        "isin": text("isin"), "venue": F.col("venue"), "trade_date": day, "as_of_date": day, "local_symbol": F.when(~new & bse, text("instrument_id")).otherwise(text("symbol")),
        "scrip_code": F.when(bse, text("instrument_id")),
    }
    return rows.where("error IS NULL AND at IS NOT NULL").select("day", text("series").alias("series"), *(columns[f.name].alias(f.name) for f in BAR))


def read_days(spark: SparkSession, root: str, venues: dict[str, str], versions: DataFrame) -> DataFrame:
    """Canonical equity bars of every readable day file; files that aren't are told by ``bad_files``."""
    return typed(scan_days(spark, root, venues, versions)).where(equity_of_venue()).drop("series")


def bad_files(scanned: DataFrame) -> DataFrame:
    """``source_id``, ``day``, ``path`` and ``error`` of the files that gave no rows because they can't be read."""
    return scanned.where("error IS NOT NULL").select("source_id", "day", "path", "error")


def outcomes(scanned: DataFrame, first: str, last: str) -> DataFrame:
    """``source_id``, ``published``, ``missing`` and ``failed``: the weekdays of a range by what became of each.

    A day without a file, or whose file is a web page, is missing; one whose file can't be read has failed. Weekday
    files alone count; a day with a readable file beside others is published.
    """
    files = scanned.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.weekday("day") < 5)).groupBy("source_id", "day", "path").agg(F.max("error").alias("error"))
    best = files.groupBy("source_id", "day").agg(F.min(F.when(F.col("error").isNull(), 0).when(F.col("error").startswith("failed"), 1).otherwise(2)).alias("state"))
    counted = best.groupBy("source_id").agg(F.count_if(F.col("state") == 0).alias("published"), F.count_if(F.col("state") == 1).alias("failed"))
    days = F.size(F.filter(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")), lambda d: F.weekday(d) < 5)).cast("long")
    return counted.select("source_id", "published", (days - F.col("published") - F.col("failed")).alias("missing"), "failed")
