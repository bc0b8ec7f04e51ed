"""Operation logs and tables from DataFrames and from binary files."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from itertools import dropwhile, islice, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bloom import Bits
from ..operators.merge import valid_prefix
from ..schema import LOG_HEADER, LOG_OPS, TABLE_FOOTER, TABLE_MAGIC, TOMBSTONE_LENGTH
from ..ship import ship

_HEADER, _FOOTER, _U32, _U64 = struct.Struct(LOG_HEADER), struct.Struct(TABLE_FOOTER), struct.Struct("<I"), struct.Struct("<Q")
ROWS = 10_000  # entries of a table sent on at once


def from_frame(df: DataFrame, seq: Column, op: Column, key: Column, value: Column) -> DataFrame:
    """An operation log from any DataFrame; a delete has no value."""
    return df.select(seq.cast("long").alias("seq"), op.alias("op"), key.cast("binary").alias("key"), F.when(op == "P", value.cast("binary")).alias("value"))


def decode_log(data: bytes):
    """(operation, key, value) of a log's records, up to the first that is cut short, damaged or unknown."""
    at = 0
    while at + _HEADER.size <= len(data):
        op, nk, nv = _HEADER.unpack_from(data, at)
        end = at + _HEADER.size + nk + nv
        if end + 4 > len(data) or zlib.crc32(data[at:end]) != _U32.unpack_from(data, end)[0] or op not in LOG_OPS:
            return
        key = at + _HEADER.size
        yield LOG_OPS[op], data[key : key + nk], data[key + nk : end]
        at = end + 4


def encode_record(op: str, key: bytes, value: bytes = b"") -> bytes:
    body = _HEADER.pack(1 if op == "P" else 2, len(key), len(value)) + key + value
    return body + _U32.pack(zlib.crc32(body))


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, pos, op, key, value) of binary logs, the valid prefix of each. A missing file gives no rows."""
    ship(spark)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if jpath(p).getFileSystem(hadoop).globStatus(jpath(p))]
    schema = "path string, pos long, op string, key binary, value binary"
    if not there:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            rows = [(p, i, op, k, v if op == "P" else None) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for i, (op, k, v) in enumerate(decode_log(c))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["path", "pos", "op", "key", "value"])

    return spark.read.format("binaryFile").load(list(there)).select("path", "content").mapInArrow(run, schema)


class TableFile:
    """A binary table in memory: its footer is read at once, entries where they are asked for.

    ValueError if it isn't a table. A file without a filter or an index is searched all the same.
    """

    def __init__(self, data: bytes, path: str = ""):
        foot = len(data) - len(TABLE_MAGIC) - _FOOTER.size
        if foot < len(TABLE_MAGIC) or not data.startswith(TABLE_MAGIC) or not data.endswith(TABLE_MAGIC):
            raise ValueError(f"not a table file: {path}")
        size, index_at, index_size, filter_at, filter_size, self.num_entries, n_min, n_max = _FOOTER.unpack_from(data, foot)
        self.data, self.end = data, len(TABLE_MAGIC) + size
        bounds = data[foot - n_min - n_max : foot]
        self.min_key, self.max_key = bounds[:n_min] or None, bounds[n_min:] or None
        self.filter = Bits(data[filter_at : filter_at + filter_size]) if filter_size else None
        self.index_keys, self.index_places, at = [], [], index_at
        while at < index_at + index_size:
            at = self._field(at, self.index_keys)
            self.index_places.append(_U64.unpack_from(data, at)[0] + len(TABLE_MAGIC))
            at += _U64.size

    def _field(self, at: int, into: list) -> int:
        """Append the sized field at a place to a list (None: a tombstone); the place after it."""
        (n,) = _U32.unpack_from(self.data, at)
        at += _U32.size
        if n == TOMBSTONE_LENGTH:
            into.append(None)
            return at
        into.append(self.data[at : at + n])
        return at + n

    def entries(self, at: int = len(TABLE_MAGIC)):
        """(key, value) from a place on, in key order."""
        while at < self.end:
            entry: list = []
            at = self._field(self._field(at, entry), entry)
            yield tuple(entry)

    def seek(self, key: bytes) -> int:
        """The place of the last indexed entry not above ``key``."""
        k = bisect_right(self.index_keys, key)
        return self.index_places[k - 1] if k else len(TABLE_MAGIC)

    def may_hold(self, key: bytes) -> bool:
        """By bounds, then by the filter; False means surely absent."""
        if self.min_key is not None and not self.min_key <= key <= (self.max_key or b""):
            return False
        return self.filter is None or self.filter.may_hold(key)

    def get(self, key: bytes) -> tuple[bool, bytes | None]:
        """(found, value): a tombstone is found and has no value."""
        if not self.may_hold(key):
            return False, None
        near = next((e for e in self.entries(self.seek(key)) if e[0] >= key), (None, None))
        return (True, near[1]) if near[0] == key else (False, None)

    def range(self, start: bytes | None, end: bytes | None):
        """(key, value) with start <= key <= end, from the place that the index tells."""
        first = dropwhile(lambda e: start is not None and e[0] < start, self.entries(len(TABLE_MAGIC) if start is None else self.seek(start)))
        return takewhile(lambda e: end is None or e[0] <= end, first)


def decode_table(data: bytes, path: str = "") -> tuple[dict, list[tuple[bytes, bytes | None]]]:
    """Meta and sorted entries (None: tombstone) of a binary table; ValueError if it isn't one."""
    t = TableFile(data, path)
    return {"num_entries": t.num_entries, "min_key": t.min_key, "max_key": t.max_key}, list(t.entries())


def _files(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def _table_batch(rows: list[tuple]) -> pa.RecordBatch:
    path, key, value = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(key, pa.binary()), pa.array([v is None for v in value], pa.bool_()), pa.array(value, pa.binary())], ["path", "key", "tomb", "value"])


def read_tables(spark: SparkSession, *paths: str, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """(path, key, tomb, value) of binary table files, with start <= key <= end."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = ((p, k, v) for k, v in TableFile(c, p).range(start, end))
                while part := list(islice(rows, ROWS)):
                    yield _table_batch(part)

    return _files(spark, paths).mapInArrow(run, "path string, key binary, tomb boolean, value binary")


def lookup_tables(spark: SparkSession, keys: list[bytes], *paths: str) -> DataFrame:
    """(path, key, tomb, value) for each of a list of keys in each table file that holds it.

    Bounds and filter rule files out; the index tells where to look in the others.
    """

    def run(batches):
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                table = TableFile(c, p)
                yield _table_batch([(p, k, v) for k in sorted(set(keys)) for found, v in (table.get(k),) if found])

    return _files(spark, paths).mapInArrow(run, "path string, key binary, tomb boolean, value binary")


def replayed(records: DataFrame, position: str = "seq", ok: str = "ok") -> DataFrame:
    """The operations that a replay takes from a log whose records were checked."""
    return valid_prefix(records, position, ok)
