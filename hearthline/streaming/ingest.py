"""Listings that arrive as files, merged into a snapshot batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import merge_snapshot
from ..sources.snapshot_store import SnapshotStore


def merge_stream(spark: SparkSession, incoming: str, schema: StructType, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str, form: str = "parquet", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start a query over new files of a folder: each batch (after `transform`) is merged into load() and handed to store().

    A batch is idempotent by key, so one that is repeated after a failure changes nothing. Rows that a batch lacks stay active:
    only a whole crawl, merged in one batch job, says what is gone.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        store(merge_snapshot(load(), rows, deactivate=False), batch_id)

    stream = spark.readStream.schema(schema).format(form).load(incoming)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream_into(store: SnapshotStore, incoming: str, schema: StructType, checkpoint: str, stream: str = "crawl", form: str = "parquet", transform: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None) -> StreamingQuery:
    """Start a query over new files of a folder: each batch (after `transform`) is merged into a bucketed store, `files` of them at a time.

    A batch reads and writes the buckets of its keys only, and is committed by one manifest that also holds its number: one that
    is repeated after a failure, before or after its commit, changes nothing. Rows may arrive in any order of seen_at. What a
    crawl has not seen is for store.end_crawl, once all of it is there.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        store.merge(transform(batch) if transform else batch, stream, batch_id, in_order=False)

    reader = store.spark.readStream.schema(schema).format(form)
    stream_ = (reader.option("maxFilesPerTrigger", files) if files else reader).load(incoming)
    return stream_.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
