"""Streams: file ingest with checkpoints, and an idempotent table over an at-least-once feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..store import Table


def append_all(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, once; a rerun with the same checkpoint adds only what is new."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
    if not every:
        q.awaitTermination()
    return q


def insert_only(stream: DataFrame, table: Table, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each key's first row is kept. A batch that runs again after a crash finds its keys there and adds nothing.

    A batch reads the table's keys and appends its own new rows; what is stored is never written again.
    """

    def merge_batch(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        if table.exists():
            new = new.join(table.read().select(*keys), keys, "left_anti")
        table.append(new)

    return each_batch(stream, checkpoint, merge_batch)


def upsert(stream: DataFrame, table: Table, keys: list[str], sequence_by: str, checkpoint: str) -> StreamingQuery:
    from pyspark.sql import functions as F

    def merge_batch(batch: DataFrame, _: int) -> None:
        last = merge.latest(batch, keys, F.desc_nulls_last(sequence_by))
        table.write(merge.upsert(table.read(), last, keys, sequence_by) if table.exists() else last)

    return each_batch(stream, checkpoint, merge_batch)


def progress(q: StreamingQuery) -> dict[str, object]:
    """What the last batch with rows did: batch id, rows, rows a second."""
    last = next((p for p in reversed(q.recentProgress) if p["numInputRows"]), q.lastProgress) or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows", 0), "rows_per_second": last.get("processedRowsPerSecond")}


def from_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
