"""Scalar functions of the engine, as columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FALSE_POSITIVES


def encode(text: Column) -> Column:
    """UTF-8 bytes of a string."""
    return text.cast("binary")


def decode(data: Column) -> Column:
    """A string of bytes; bytes that aren't UTF-8 are replaced."""
    return F.make_valid_utf8(data.cast("string"))


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of an entry in a table's data block: two lengths, the key, and the value if there is one."""
    return (F.lit(8) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def record_size(key: Column, value: Column) -> Column:
    """Bytes of a log record: header and checksum (13), key and value."""
    return (F.lit(13) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def checksum(data: Column) -> Column:
    return F.crc32(data)


def run_name(run: Column) -> Column:
    return F.format_string("%010d", run)


def bloom_size(items: Column, rate: float = FALSE_POSITIVES) -> tuple[Column, Column]:
    """Bits and hashes of a bloom filter for so many items."""
    n = F.greatest(items, F.lit(1)).cast("double")
    bits = F.greatest(F.lit(8), F.ceil(-(n * math.log(rate)) / math.log(2) ** 2)).cast("long")
    return bits, F.greatest(F.lit(1), F.rint(bits / n * math.log(2))).cast("long")


def bloom_places(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key in a filter of ``bits``, by double hashing of one blake2b digest (16 bytes).

    No built-in function has this hash; it serves to read filters that others have written.
    """

    from .bloom import places

    @F.pandas_udf("array<long>")
    def of_keys(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: places(bytes(k), bits, hashes), na_action="ignore")

    return of_keys(key)


def little_endian(n: Column, size: int = 4) -> Column:
    """A number's lowest bytes, the lowest first."""
    byte = lambda i: F.unhex(F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0"))
    return F.concat(*[byte(i) for i in range(size)])


def record_body(op: Column, key: Column, value: Column) -> Column:
    """What a log record's checksum covers: operation, lengths of key and value, key, and value if there is one."""
    value = F.coalesce(value, F.lit(b""))
    code = F.when(op == "P", F.lit(b"\x01")).otherwise(F.lit(b"\x02"))
    return F.concat(code, little_endian(F.octet_length(key)), little_endian(F.octet_length(value)), key, value)
