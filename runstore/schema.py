"""Schemas of operation logs and runs, and the engine's fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DELETE = "P", "D"

#: An operation: seq is a total order, and the newest operation of a key wins.
OPLOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
#: A row of a run: one for each key; a tombstone has no value.
ENTRY = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("tomb", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

# Defaults and formats that results depend on.
FLUSH_BYTES = 1 << 20
COMPACT_RUNS = 4
INDEX_INTERVAL = 16
FALSE_POSITIVES = 0.01
LOG_HEADER = "<BII"  # operation, key length, value length; then key, value and CRC-32
LOG_OPS = {1: PUT, 2: DELETE}
TABLE_MAGIC = b"LSST"
TABLE_FOOTER = "<QQQQQQII"  # data length, index offset and length, bloom offset and length, entries, min and max key length
TOMBSTONE_LENGTH = 0xFFFFFFFF
FILTER_HEADER = "<III"  # bits, hashes, bytes that follow
