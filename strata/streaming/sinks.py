"""Sinks that take effect once even when a micro-batch is delivered twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from strata.plans.strategies import incremental
from strata.sources.versioned import VersionedTable


def once_per_batch(stream: DataFrame, name: str, apply: Callable) -> DataStreamWriter:
    """Call ``apply(rows, key)`` per micro-batch with a key that a replayed batch
    repeats, for writes that skip keys they have seen. Batches are numbered by their
    checkpoint, so the key names it too: a new checkpoint counts from 0 again, over
    whatever there is to read by then."""

    def write(rows: DataFrame, batch_id: int) -> None:
        checkpoint = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        apply(rows, f"{name}-{checkpoint}-{batch_id}")

    return stream.writeStream.queryName(name).foreachBatch(write)


def append_stream(stream: DataFrame, name: str, table: VersionedTable) -> DataStreamWriter:
    return once_per_batch(stream, name, lambda rows, key: table.append(rows, key=key))


def merge_stream(stream: DataFrame, name: str, table: VersionedTable, keys) -> DataStreamWriter:
    """For update-mode aggregates: each micro-batch replaces the rows it restates."""
    return once_per_batch(stream, name, lambda rows, key: table.merge(rows, keys, key=key)).outputMode("update")


def incremental_stream(
    stream: DataFrame, name: str, table: VersionedTable, unique_key, watermark: str
) -> DataStreamWriter:
    """The incremental load as a continuous job. What is new is the checkpoint's to
    say; the load only keeps a key's older rows from replacing newer ones."""
    return once_per_batch(
        stream, name, lambda rows, key: incremental(table, rows, unique_key, watermark, key=key)
    )


def drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process everything available now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
