"""Deduplication of a stream of peak events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import deduplicate


def deduplicate_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's summed intensities under ``path``, in a folder of the batch.

    Sums of sums are sums, so :func:`deduplicated` adds the folders up to those of
    all events so far. Nothing is kept in the driver or in state, and a batch that
    is run again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        deduplicate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def deduplicated(batches: DataFrame) -> DataFrame:
    """The summed intensities of the batches read from the stream's folder."""
    return deduplicate(batches.drop("batch"))
