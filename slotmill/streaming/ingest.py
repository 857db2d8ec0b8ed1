"""Streaming ingest: fingerprints of a stream of programs, upserted into a Parquet catalog.

An extension beyond batch scans. Fingerprinting is row-local, so the stream needs no state;
each micro-batch is one upsert of the ids it brings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.fingerprint import fingerprints


def ingest(programs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends each batch's fingerprints below `target`, by batch number.

    A batch that is retried after a failure rewrites its own folder, so rows appear once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    prints = fingerprints(programs)
    return prints.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
