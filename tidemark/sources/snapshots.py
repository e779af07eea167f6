"""Tables that are replaced whole or in parts without a moment in which they are broken.

Data goes to folders of its own and is never changed there; a version is a small file that lists the folders of each
part. A write stages its folders first and then creates the next version's file, which fails if another writer has
created it meanwhile. Until then, and after any failure, readers see the version before. Readers of an older version
keep its folders until ``expire`` drops it.

    <root>/_versions/00000007.json     {"parts": {"1996": ["data/3f...", ...]}, "schema": ..., "note": ...}
    <root>/data/<id>/_part=1996/...    Parquet
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.asof import first_of_group
from tidemark.operators.quality import checked
from tidemark.sources import sinks

WHOLE = "all"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to make."""


class RepeatedKeys(ValueError):
    """Facts whose key is in the table already."""


class Store:
    """One table below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        place = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._files().listStatus(place)) if self._files().exists(place) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"parts": {}, "schema": None, "note": None}
        stream = self._files().open(self._path("_versions", f"{version:08}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, parts: Iterable[str] | None = None, schema: StructType | None = None) -> DataFrame:
        """A version's rows, or those of some parts alone; other parts' folders aren't even listed.

        A table without versions is empty and takes ``schema``.
        """
        held = self.manifest(version)
        shape = StructType.fromJson(held["schema"]) if held["schema"] else schema
        if shape is None:
            raise ValueError(f"{self.root} has no version yet")
        wanted = held["parts"] if parts is None else {p: held["parts"][p] for p in parts if p in held["parts"]}
        folders = [f"{self.root}/{f}" for fs in wanted.values() for f in fs]
        return self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)

    def stage(self, rows: DataFrame, part: Column | None = None, dealt: bool = False) -> dict[str, list[str]]:
        """Write rows to a new folder, by part if one is given (never null); what was written, by part. No reader sees it yet.

        Rows that are ``dealt`` lie by part, so that a part is in few tasks, and are written from where they are.
        """
        folder = f"data/{uuid.uuid4().hex}"
        if part is None:
            rows.write.parquet(f"{self.root}/{folder}")
            return {WHOLE: [folder]}
        # Large parts are dealt to several tasks by their size, small ones share one; without adaptive plans a part is one task's.
        named = rows.withColumn("_part", part)
        named = named if dealt else named.hint("rebalance", "_part")
        named.write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        return {unquote(n[6:]): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("_part=")}

    def commit(self, parts: dict[str, list[str]], schema: StructType, base: int, note: dict | None = None) -> int:
        """Make ``parts`` the version after ``base``; another writer's commit since then is a ``Conflict``."""
        body = json.dumps({"parts": parts, "schema": json.loads(schema.json()), "note": note})
        place = self._path("_versions", f"{base + 1:08}.json")
        aside = self._path("_versions", f".{uuid.uuid4().hex}")
        files = self._files()
        stream = files.create(aside, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        try:
            if self.version() != base or files.exists(place) or not files.rename(aside, place):
                raise Conflict(f"{self.root}: version {base + 1} is there already")
        finally:
            files.delete(aside, False)
        return base + 1

    def replace(self, rows: DataFrame, part: Column | None = None, touched: Sequence[str] | None = None, base: int | None = None, note: dict | None = None, dealt: bool = False) -> int:
        """The table's next version: ``rows`` in place of all parts, or of the parts ``touched`` alone; a column ``_part`` is not stored."""
        base = self.version() if base is None else base
        held = self.manifest(base)["parts"] if touched is not None else {}
        staged = self.stage(rows, part, dealt)
        if touched is not None and (outside := sorted(set(staged) - set(touched))):
            raise ValueError(f"rows of parts that were not to change: {outside[:5]}")
        return self.commit({p: f for p, f in held.items() if p not in (touched or ())} | staged, rows.drop("_part").schema, base, note)

    def add(self, rows: DataFrame, part: Column | None = None, base: int | None = None, note: dict | None = None) -> int:
        """The table's next version: what is there and ``rows``."""
        base = self.version() if base is None else base
        held = self.manifest(base)["parts"]
        staged = self.stage(rows, part)
        return self.commit({p: held.get(p, []) + staged.get(p, []) for p in sorted({*held, *staged})}, rows.schema, base, note)

    def expire(self, keep: int = 2) -> int:
        """Drop all but the newest versions and the folders that none of those lists; how many versions went."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        needed = {f.split("/")[1] for v in kept for fs in self.manifest(v)["parts"].values() for f in fs}
        for v in old:
            self._files().delete(self._path("_versions", f"{v:08}.json"), False)
        for name in self._names("data"):
            if name not in needed:
                self._files().delete(self._path("data", name), True)
        return len(old)


def merge_into(store: Store, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Commit ``merge(what is there, incoming)``; a merge that fails, or loses to another writer, leaves the table as it was."""
    base = store.version()
    there = store.read(base, schema=incoming.schema)
    return store.replace(merge(there, incoming).select(*there.columns), base=base)


#: How each table takes new rows.
MERGES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "instrument_master": sinks.merge_instruments, "listing": sinks.merge_listings, "instrument_primary_venue": sinks.add_primary_venues, "trading_day": sinks.add_verdicts,
    "source_registry": sinks.merge_sources, "source_schema_version": sinks.replace_versions,
}


def sync_registry(spark: SparkSession, root: str, sources: DataFrame, versions: DataFrame) -> None:
    """Take over a registry: sources are upserted, and all schema versions of the sources given are replaced; others stay.

    Sources come first, so that no version is without its source.
    """
    merge_into(Store(spark, f"{root}/source_registry"), sources, MERGES["source_registry"])
    named = sources.select("source_id").join(versions, "source_id", "left").where("version IS NULL").select("source_id")

    def replaced(there: DataFrame, incoming: DataFrame) -> DataFrame:
        """A source without versions loses those it had."""
        return sinks.replace_versions(there.join(named, "source_id", "left_anti"), incoming)

    merge_into(Store(spark, f"{root}/source_schema_version"), versions, replaced)


FACT_KEYS = {
    "price_daily": ("isin", "venue", "trade_date", "as_of_date"), "delivery_daily": ("isin", "venue", "trade_date", "as_of_date"),
    "corporate_action": ("isin", "action_type", "ex_date", "source_id", "as_of_date", "qualifier"), "trading_day": ("venue", "trade_date", "as_of_date"),
}


def append_new(store: Store, facts: DataFrame, table: str, on_repeat: str = "drop", day: str | None = None) -> int:
    """Append the facts whose key is not in the table yet; how many were repeated.

    Keys are compared in the years that the facts touch, and only these years' folders are read. Repeated keys are
    dropped, or, with ``on_repeat="fail"``, fail the append with their number and a few of them; so are keys that
    repeat inside ``facts``, of which the first by its other columns stays. Rows that break a rule fail the write.
    Nothing new commits nothing.
    """
    keys, day = FACT_KEYS[table], day or ("ex_date" if table == "corporate_action" else "trade_date")
    year = F.year(day).cast("string")
    base = store.version()
    others = [F.col(c).asc_nulls_first() for c in facts.columns if c not in keys]
    once = first_of_group(facts, keys, *others) if others else facts.dropDuplicates(keys)
    years = [r[0] for r in facts.select(year.alias("y")).distinct().collect()]
    there = store.read(base, years, facts.schema).select(*keys)
    news = once.join(there, list(keys), "left_anti").select(*facts.columns)
    repeated = facts.count() - news.count()
    if repeated and on_repeat == "fail":
        again = facts.select(*keys).join(there, list(keys), "left_semi").unionByName(facts.groupBy(*keys).count().where("count > 1").select(*keys))
        raise RepeatedKeys(f"{repeated} repeated keys of {table}, such as {[tuple(map(str, r)) for r in again.distinct().orderBy(*keys).limit(3).collect()]}")
    if facts.isEmpty() or repeated and news.isEmpty():
        return repeated
    store.add(checked(news, table), year, base)
    return repeated


#: Rows of a month, about, that one task takes up.
SHARE = 1_000_000


def keep_latest(store: Store, batch: DataFrame, keys: Sequence[str], day: str = "trade_date", batch_id: int | None = None) -> list[str]:
    """Bring a kept table of latest versions up to date with a batch of facts; the months that were rewritten.

    Each key of the batch meets its kept row alone, and the newer as-of date stays (the kept row among equals). Months
    without a key of the batch keep their folders. With ``batch_id`` a batch that was taken already changes nothing,
    so a stream may deliver it again.
    """
    base = store.version()
    note = store.manifest(base)["note"] or {}
    if batch_id is not None and note.get("batch", -1) >= batch_id:
        return []
    month = F.date_format(day, "yyyy-MM")
    sizes = lambda rows: dict(rows.groupBy(F.trunc(day, "month").alias(day)).count().select(month, "count").collect())
    come = sizes(batch)
    months = sorted(come)
    if not months:
        return []
    kept = store.read(base, months, batch.schema)
    both = kept.withColumn("_age", F.lit(0)).unionByName(batch.withColumn("_age", F.lit(1)))
    others = [F.col(c).asc_nulls_first() for c in batch.columns if c not in keys and c != "as_of_date"]
    # One exchange and one sort serve the choice and the write: both go by month and, in large months, by a share of the keys.
    there = sizes(kept) if store.manifest(base)["parts"] else {}
    shares = {m: -(-(n + there.get(m, 0)) // SHARE) for m, n in come.items()}
    part, rest, count = F.coalesce(month, F.lit("")), [k for k in keys if k != day], F.lit(1)
    for m, n in shares.items():
        count = F.when(part == m, n).otherwise(count) if n > 1 else count
    share = F.pmod(F.xxhash64(*rest), count) if rest else F.lit(0)
    tasks = min(sum(shares.values()), int(store.spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.withColumns({"_part": part, "_share": share}).repartition(tasks, "_part", "_share")
    newest = first_of_group(dealt, ["_part", "_share", *keys], F.col("as_of_date").desc(), F.col("_age"), *others).select(*batch.columns, "_part")
    store.replace(newest, F.col("_part"), months, base, {"batch": batch_id} if batch_id is not None else note or None, dealt=True)
    return months
