"""Entries as a bucketed table: merging them needs no exchange.

A run in a store is range-partitioned, which suits scans and pruning. Where whole states are merged
again and again, a table bucketed by key lets each merge, compaction and batch lookup read its own
buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import newest_wins


def write_bucketed(entries: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Append entries (key, seq, tomb, value) to ``table``, sorted within ``buckets`` buckets of the key.

    The rows are dealt by the buckets' own hash first, so that each bucket gets one file.
    """
    writer = entries.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").mode("append").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def merged(spark: SparkSession, table: str, keep_tombstones: bool = False) -> DataFrame:
    return newest_wins(spark.table(table), keep_tombstones)
