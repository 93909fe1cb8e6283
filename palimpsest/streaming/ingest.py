"""Versions from a stream: each micro-batch of changes is one version.

The version is the batch's number after the archive's last version at the stream's start. A batch that Spark repeats after a
failure writes the same version again, or is skipped if it was committed; so every batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.model import LOG_SCHEMA, TRIPLE
from palimpsest.operators.changes import overlay
from palimpsest.sources.store import Store


def ingest(store: Store, changes: DataFrame, checkpoint: str, first: int, **trigger) -> StreamingQuery:
    """Starts a query that appends a streaming frame (s, p, o, op) to a stored archive.

    :param first: the version of batch 0; the same at each restart with this checkpoint
    :param trigger: as ``DataStreamWriter.trigger`` takes
    """

    def append(batch: DataFrame, number: int) -> None:
        version = first + number
        if version > store.open().highest:
            store.append(version, batch.select(*TRIPLE, "op"))

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_latest(store: Store, changes: DataFrame, checkpoint: str, first: int, order: str, **trigger) -> StreamingQuery:
    """As ingest, of frames (s, p, o, op, order): of a triple's changes in a batch the last in this order counts."""

    def append(batch: DataFrame, number: int) -> None:
        version = first + number
        if version > store.open().highest:
            store.append(version, overlay(batch, order))

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def versioned_stream(spark, folder: str) -> DataFrame:
    """A stream of the log files (version, s, p, o, op) that appear in a folder of Parquet."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(folder)
