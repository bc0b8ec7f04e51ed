"""The engine's rule as DataFrame plans: of each key the newest operation wins, tombstones go last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(ops: DataFrame) -> DataFrame:
    """Operations (seq, op, key, value) as entries (key, seq, tomb, value); a delete has no value."""
    tomb = F.col("op") == "D"
    return ops.select("key", "seq", tomb.alias("tomb"), F.when(~tomb, F.col("value")).alias("value"))


def newest_wins(rows: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """One entry for each key, that of the highest seq.

    A filter on the key passes below the aggregation; that on tombstones must not, or a deleted
    key's older value would come back, so it stands above it. Partial aggregation leaves one row a
    key and task to shuffle. seq must be unique in a key; equal ones tie by tomb and value.
    """
    top = F.max(F.struct("seq", "tomb", "value")).alias("_top")
    merged = rows.groupBy("key").agg(top).select("key", "_top.seq", "_top.tomb", "_top.value")
    return merged if keep_tombstones else merged.where(~F.col("tomb"))


def between(start, end, key: str = "key") -> Column:
    """Both bounds are inclusive; None is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(key) >= F.lit(start))
    if end is not None:
        out = out & (F.col(key) <= F.lit(end))
    return out


def scan(rows: DataFrame, start=None, end=None, as_of: int | None = None) -> DataFrame:
    """(key, value) of the merged state in key order. ``as_of`` (an extension) leaves later operations out."""
    if as_of is not None:
        rows = rows.where(F.col("seq") <= as_of)
    return newest_wins(rows.where(between(start, end))).select("key", "value").orderBy("key")


def multi_get(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, value) for each distinct key asked for (an extension: point lookups in a batch).

    Entries are first cut down to the keys asked for, so that only those are merged; Spark
    broadcasts the keys if their size lets it.
    """
    keys = keys.select("key").distinct()
    hit = newest_wins(rows.join(keys, "key", "left_semi")).select("key", "value", F.lit(True).alias("_hit"))
    return keys.join(hit, "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("found"), "value")


def contains(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys with any entry, a tombstone too."""
    return keys.select("key").distinct().join(rows.select("key"), "key", "left_semi")


def remove(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without these keys: they go physically, and leave no tombstone."""
    return rows.join(keys.select("key"), "key", "left_anti")


def by_run(rows: DataFrame) -> DataFrame:
    """Of rows with a column ``run``, the newest entry of each key in each run, tombstones kept."""
    top = F.max(F.struct("seq", "tomb", "value")).alias("_top")
    return rows.groupBy("run", "key").agg(top).select("run", "key", "_top.seq", "_top.tomb", "_top.value")


def serving_run(rows: DataFrame) -> DataFrame:
    """(key, run, tomb): the newest run that holds each key, which is where a lookup ends."""
    top = F.max(F.struct("run", "tomb")).alias("_top")
    return rows.groupBy("key").agg(top).select("key", "_top.run", "_top.tomb")


def run_meta(rows: DataFrame, *by: str) -> DataFrame:
    """num_entries (tombstones count), min_key, max_key and tombstones, by run if asked."""
    measures = [F.count("*").alias("num_entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count_if("tomb").alias("tombstones")]
    return rows.groupBy(*by).agg(*measures) if by else rows.agg(*measures)


def tail_size(rows: DataFrame) -> DataFrame:
    """entries and size_bytes of an unflushed tail: key and value bytes of the newest entry of each key."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return newest_wins(rows, keep_tombstones=True).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size_bytes"))


def payload(rows: DataFrame) -> int:
    """Bytes of keys and values in all of ``rows`` (key, value)."""
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    return rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def valid_prefix(records: DataFrame, position: str = "pos", ok: str = "ok", log: str | None = None) -> DataFrame:
    """The records before the first bad one of each log: what may be replayed after a crash.

    The bad record's place is an aggregate of one row a log, so no log has to be ordered in one task.
    """
    bad = records.where(~F.col(ok))
    if log is None:
        first = bad.agg(F.min(position)).scalar()
        return records.where(first.isNull() | (F.col(position) < first))
    # a row for each log with a bad record at most
    joined = records.join(bad.groupBy(log).agg(F.min(position).alias("_bad")), log, "left")
    return joined.where(F.col("_bad").isNull() | (F.col(position) < F.col("_bad"))).drop("_bad")
