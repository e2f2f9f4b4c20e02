"""Incremental ingest: new raw files as a stream, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tarnbeck.sources.tables import AppendLog, VersionedTable


def available_now(
    spark: SparkSession, source: str, schema: StructType, checkpoint: str, sink: Callable[[DataFrame, int], None], pattern: str | None = None,
    files_a_batch: int | None = None,
) -> None:
    """Run all files that the stream hasn't seen through sink, then stop; in batches of so many files, if
    that is given. The checkpoint remembers what was seen; a batch that is run again after a crash has
    the same number."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    stream = reader.parquet(source)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_batches(log: AppendLog) -> Callable[[DataFrame, int], None]:
    """A sink that stores each batch under its number, so running it again replaces it."""
    return lambda batch, number: log.append(batch, f"{number:012d}")


def upsert_batches(
    table: VersionedTable, refine: Callable[[DataFrame], DataFrame], choose: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """A sink that merges what refine makes of each batch; merging again changes nothing. choose picks
    one row of each key among the batch's and the table's, as a late row may be older than the one
    that is stored; without it the batch's row replaces it."""

    def sink(batch: DataFrame, number: int) -> None:
        made = refine(batch).persist()
        try:
            table.merge(made, choose)
        finally:
            made.unpersist()

    return sink
