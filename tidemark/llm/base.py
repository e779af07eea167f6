"""Helpers shared by the text operators: reading tables, Arrow batches, deterministic samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes handed to a Python worker at once, so that a batch of long texts stays small.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: A key with over one in so many of the rows is hot; and the fewest rows of a hot key.
HOT_KEYS, LEAST_HOT = 1000, 10_000


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests) gets a
    folder under its warehouse; a cluster is told to set one, since its executors share no local folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, lookup: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join (``how``: inner or left) of ``rows``, whose keys may be skewed, to ``lookup``, which has one row a key; null keys meet nothing.

    Keys with over one in ``HOT_KEYS`` of the rows are ``HOT_KEYS`` at most, so their rows of ``lookup`` are broadcast
    and ``rows`` of such keys stay where they are; all others meet in a shuffle. ``rows`` are read three times: they
    should be cheap to read, such as a checkpoint.
    """
    counted = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("_n"))
    bound = max(LEAST_HOT, rows.count() // HOT_KEYS)
    hot = counted.where(F.col("_n") > bound).select(*keys)
    held = hot.collect()
    if not held:
        return rows.join(lookup, list(keys), how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(held, hot.schema))
    near = F.broadcast(lookup.join(hot, list(keys), "left_semi"))
    far = rows.join(hot, list(keys), "left_anti").join(lookup.join(hot, list(keys), "left_anti"), list(keys), how)
    here = rows if how == "inner" else rows.join(hot, list(keys), "left_semi")
    return here.join(near, list(keys), how).unionByName(far)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id``, the whole text (null: empty) and the columns named; other columns are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def remainder(modulus: int) -> Column:
    """crc32 of the document id as text, modulo ``modulus``: the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``make`` runs once a task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            if (out := step(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
