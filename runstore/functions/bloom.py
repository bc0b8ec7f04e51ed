"""Bloom filters: as a small table of bitmaps, built and probed by DataFrame operations, and as bytes."""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FALSE_POSITIVES, FILTER_HEADER
from .scalar import bloom_places

SPAN = 4096 * 8  # bits of a bitmap; Spark counts them from 1
#: A filter of more bytes isn't gathered into one value.
LARGEST = 256 << 20


@dataclass
class Bloom:
    """``bitmaps``: (bucket, bitmap); at least 8 bits and one hash.

    ``portable``: places are those that filters in bytes use, by blake2b; else by xxhash64, which
    Spark has built in.
    """

    bits: int
    hashes: int
    bitmaps: DataFrame
    portable: bool = False

    def might_contain(self, keys: DataFrame) -> DataFrame:
        """The distinct keys with a column ``maybe``; False means surely absent."""
        places = keys.select("key").distinct().withColumn("place", F.explode(_places(F.col("key"), self.bits, self.hashes, self.portable)))
        probed = places.withColumn("bucket", F.bitmap_bucket_number(F.col("place") + 1)).join(self.bitmaps, "bucket", "left")
        at = F.bitmap_bit_position(F.col("place") + 1)
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
        return probed.groupBy("key").agg(F.every(hit).alias("maybe"))

    def to_bytes(self) -> bytes:
        """The filter as one value: header, then bits from the lowest of each byte on."""
        n = -(-self.bits // 8)
        if n > LARGEST:
            raise ValueError(f"a filter of {n} bytes stays a table")
        out = bytearray(n)
        for r in self.bitmaps.collect():  # n bytes in all
            first = (r.bucket - 1) * SPAN // 8
            part = bytes(r.bitmap)[: n - first]
            out[first : first + len(part)] = part
        return struct.pack(FILTER_HEADER, self.bits, self.hashes, n) + bytes(out)


def from_bytes(spark: SparkSession, data: bytes) -> Bloom:
    """A filter that was written by ``to_bytes``, or by others in the same format."""
    own = Bits(data)
    step = SPAN // 8
    rows = [(k // step + 1, bytearray(own.raw[k : k + step].ljust(step, b"\0"))) for k in range(0, len(own.raw), step)]
    return Bloom(own.bits, own.hashes, spark.createDataFrame(rows, "bucket long, bitmap binary"), portable=True)


class Bits:
    """A filter in bytes, probed key by key: for files that carry one."""

    def __init__(self, data: bytes):
        head = struct.calcsize(FILTER_HEADER)
        if len(data) < head:
            raise ValueError("not a filter: it is shorter than its header")
        self.bits, self.hashes, n = struct.unpack_from(FILTER_HEADER, data)
        self.raw = bytes(data[head : head + n])
        if self.bits < 8 or self.hashes < 1 or len(self.raw) < -(-self.bits // 8):
            raise ValueError("not a filter: its bits don't fit its header")

    def may_hold(self, key: bytes) -> bool:
        return all(self.raw[p >> 3] >> (p & 7) & 1 for p in places(key, self.bits, self.hashes))


def places(key: bytes, bits: int, hashes: int) -> list[int]:
    """The bits of one key: two halves of a blake2b digest, the second made odd, as start and step."""
    digest = int.from_bytes(hashlib.blake2b(key, digest_size=16).digest(), "little")
    start, step = digest & (1 << 64) - 1, digest >> 64
    step += 1 - step % 2
    return [(start + i * step) % bits for i in range(hashes)]


def sizes(items: int, rate: float = FALSE_POSITIVES) -> tuple[int, int]:
    items = max(1, items)
    bits = max(8, math.ceil(-(items * math.log(rate)) / math.log(2) ** 2))
    return bits, max(1, round(bits / items * math.log(2)))


def _places(key: Column, bits: int, hashes: int, portable: bool = False) -> Column:
    if portable:
        return bloom_places(key, bits, hashes)
    a, b = F.xxhash64(key), F.xxhash64(F.lit(1), key).bitwiseOR(F.lit(1))
    step = lambda i: F.pmod(F.pmod(a, F.lit(bits)) + i * F.pmod(b, F.lit(bits)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), step)


def build(keys: DataFrame, items: int, rate: float = FALSE_POSITIVES, portable: bool = False) -> Bloom:
    """A filter of the column ``key``, sized for ``items`` keys."""
    bits, hashes = sizes(items, rate)
    of_key = keys.select(F.explode(_places(F.col("key"), bits, hashes, portable)).alias("place"))
    bitmaps = of_key.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bitmap"))
    return Bloom(bits, hashes, bitmaps, portable)
