"""Layout of tables and logs as DataFrame queries: sparse index, offsets, pruning, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FALSE_POSITIVES, INDEX_INTERVAL
from .scalar import bloom_size, entry_size, record_size


def sparse_index(rows: DataFrame, interval: int = INDEX_INTERVAL, block: Column | None = None) -> DataFrame:
    """(run, i, key, offset): every 16th entry of each run with its place in the data block.

    ``block`` is any column that doesn't decrease as the key grows in a run, such as the file of a
    sorted run or a key's first bytes: entries are summed within blocks first, and blocks' totals
    then, so that no window holds more than a block or a row for each block of a run.
    """
    sized = rows.select("run", "key", entry_size(F.col("key"), F.col("value")).alias("_size"), (F.lit(0) if block is None else block).alias("_block"))
    totals = sized.groupBy("run", "_block").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    start = totals.select("run", "_block", F.coalesce(F.sum("_n").over(earlier), zero).alias("_i"), F.coalesce(F.sum("_sum").over(earlier), zero).alias("_at"))
    own = Window.partitionBy("run", "_block").orderBy("key")
    ahead = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_i0", F.row_number().over(own) - 1).withColumn("_at0", F.coalesce(F.sum("_size").over(ahead), zero))
    placed = placed.join(start, ["run", "_block"]).select("run", (F.col("_i") + F.col("_i0")).cast("long").alias("i"), "key", (F.col("_at") + F.col("_at0")).alias("offset"))
    return placed.where(F.col("i") % interval == 0)


def log_offsets(ops: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(seq, rec_len, end_offset) of each operation in a log.

    Sums run within blocks of seq first, and over the blocks' totals then, so that no window holds
    the whole log.
    """
    rows = ops.select("seq", record_size(F.col("key"), F.col("value")).alias("rec_len"), F.floor(F.col("seq") / block).alias("_block"))
    totals = rows.groupBy("_block").agg(F.sum("rec_len").alias("_sum"))
    # one row for each block of a million records
    before = totals.withColumn("_before", F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).drop("_sum")
    own = Window.partitionBy("_block").orderBy("seq")
    return rows.join(before, "_block").select("seq", "rec_len", (F.col("_before") + F.sum("rec_len").over(own)).cast("long").alias("end_offset"))


def candidate_runs(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, candidates): how many runs' bounds hold each distinct key. ``meta`` has a row for each run of a manifest.

    The runs' bounds are one array, as small as the manifest that the driver holds anyway, and each
    key counts in it by itself: no row is made for a key and run.
    """
    bounds = meta.where("min_key is not null").agg(F.collect_list(F.struct("min_key", "max_key"))).scalar()
    inside = lambda b: (F.col("key") >= b["min_key"]) & (F.col("key") <= b["max_key"])
    asked = keys.select("key").distinct().withColumn("_bounds", bounds)
    return asked.select("key", F.size(F.filter("_bounds", inside)).cast("long").alias("candidates"))


def bloom_sizing(meta: DataFrame, rate: float = FALSE_POSITIVES) -> DataFrame:
    bits, hashes = bloom_size(F.col("num_entries"), rate)
    return meta.select("run", bits.alias("num_bits"), hashes.alias("num_hashes"))
