"""Key hashes as unsigned 32-bit values in a long, and the shard and bucket numbers cut from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def unsigned(value: Column) -> Column:
    """A signed 32-bit integer as its unsigned value in a long."""
    return value.cast("long").bitwiseAND(F.lit(MASK))


def murmur3(key: Column) -> Column:
    return unsigned(F.hash(key))


def xxhash32(key: Column) -> Column:
    """The upper half of the 64-bit XXH64."""
    return F.shiftrightunsigned(F.xxhash64(key), 32)


def crc32(key: Column) -> Column:
    return F.crc32(key.cast("binary"))


def md5_32(key: Column) -> Column:
    """The first 32 bits of the MD5 digest; any SQL engine can recompute it."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


HASHES: dict[str, Callable[[Column], Column]] = {"murmur3": murmur3, "xxhash32": xxhash32, "crc32": crc32, "md5_32": md5_32}
CHECKSUMS = {"crc32": crc32, "xxhash32": xxhash32}
#: Names of block compressors and the Parquet codecs behind them.
CODECS = {"none": "none", "lz4": "lz4_raw", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd"}


def lookup(registry: dict, kind: str, name: str):
    try:
        return registry[name]
    except KeyError:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(registry))}") from None


def hash_of(key: Column, name: str = "murmur3") -> Column:
    return lookup(HASHES, "hash", name)(key)


def shard_bits(shards: int) -> int:
    if shards < 1 or shards & (shards - 1):
        raise ValueError(f"the number of shards must be a power of two, not {shards}")
    return shards.bit_length() - 1


def shard_of(h: Column, shards: int) -> Column:
    """The shard that a hash's leading bits name."""
    bits = shard_bits(shards)
    return F.shiftrightunsigned(h, 32 - bits).cast("int") if bits else F.lit(0)


def bucket_of(h: Column) -> Column:
    """The leading ten bits of a hash: which of 1024 directory entries it falls into."""
    return F.shiftrightunsigned(h, 22).cast("int")
