"""Late facts as a stream: each batch is appended, and the latest version is chosen when read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.sinks import append_facts
from tidemark.sources.snapshots import Store, keep_latest


def append_stream(stream: DataFrame, path: str, table: str, checkpoint: str, day: str = "trade_date") -> StreamingQuery:
    """Append a stream of facts as it arrives, then stop; a correction is one more row with a later as-of date."""

    def write(batch: DataFrame, _: int) -> None:
        append_facts(batch, path, table, day)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_stream(stream: DataFrame, root: str, keys: Sequence[str], checkpoint: str, day: str = "trade_date") -> StreamingQuery:
    """Keep the latest version of each fact up to date as corrections arrive, then stop; a batch delivered again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        keep_latest(Store(batch.sparkSession, root), batch, keys, day, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
