"""Structured Streaming: a stream of operations into a store, a run or log segment for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import RunStore


def ingest(ops: DataFrame, store: RunStore, name: str, checkpoint: str, **options) -> StreamingQuery:
    """Start a query that takes a stream of (seq, op, key, value) into ``store``.

    Each micro-batch becomes one run, and its number is committed with it, so a batch that Spark
    repeats after a failure is left out the second time. Late operations of lower seq lose against
    newer ones by seq; a batch must not go below what a full compaction has already merged.
    """

    def take(batch: DataFrame, number: int) -> None:
        if store.manifest.batches.get(name, -1) >= number:
            return
        rows = batch.select("seq", "op", "key", "value").persist()
        try:
            store.put_batch(rows, (name, number))
        finally:
            rows.unpersist()

    return ops.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).options(**options).queryName(name).start()
