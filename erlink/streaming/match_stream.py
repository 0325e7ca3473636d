"""Matching a stream of new master records against a static pool, micro-batch by micro-batch.

Decisions are per master record and its candidates are complete within a batch, so no watermark or state is needed.
Batches are written under their number: a batch that runs again after a failure overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def match_stream(records: DataFrame, match: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that applies match to each batch of records and writes its rows to target/batch=<number>."""

    def one(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
