"""Lookups of one key or many, and samples of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_of, hash_of

#: Keys of a multi-get up to which they are sent to every executor.
BROADCAST_KEYS = 100_000
WAYS = {"left", "inner", "semi", "anti"}


def point_get(entries: DataFrame, key: str | bytes) -> DataFrame:
    """The rows of one key; the predicate reaches the Parquet scan."""
    return entries.where(F.col("key") == F.lit(key))


def multi_get(entries: DataFrame, keys: DataFrame, how: str = "left") -> DataFrame:
    """Values of many keys at once; entries must have one row a key.

    left: every asked key, with null for a missing one; inner: only those found; semi: the found keys;
    anti: the missing ones. Keys asked twice are answered twice. Few keys are broadcast, after a count that stops at the
    bound, and so cut the entries down before what is found meets the keys again; more of them are shuffled.
    """
    if how not in WAYS:
        raise ValueError(f"how must be one of {', '.join(sorted(WAYS))}")
    asked, columns = keys.select("key"), ["key"] if how in ("semi", "anti") else ["key", "value"]
    found = entries.select(*columns)
    if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        if how == "inner":
            return found.join(F.broadcast(asked), "key")
        # no more rows than keys
        found = F.broadcast(found.join(F.broadcast(asked.distinct()), "key", "left_semi"))
    return asked.join(found, "key", how if how in ("left", "inner") else f"left_{how}").select(*columns)


def sample_keys(entries: DataFrame, n: int, hash_name: str = "md5_32") -> DataFrame:
    """n keys that no order of the input has a say in: those with the smallest hashes."""
    return entries.select("key", hash_of(F.col("key"), hash_name).alias("h")).orderBy("h", "key").limit(n).select("key")


def random_entries(entries: DataFrame, n: int, seed: int) -> DataFrame:
    """n random entries, each as likely as any other."""
    return entries.orderBy(F.rand(seed)).limit(n)


def bucket_members(masks: DataFrame) -> DataFrame:
    """(source, bucket): the directory entries, of 1024, under which a source with a shared hash prefix is listed.

    masks has source, hash_mask and shared_hash. Each source makes its buckets by itself, without a join.
    """
    inside = F.filter(F.sequence(F.lit(0), F.lit(1023)), lambda i: i.bitwiseAND(bucket_of(F.col("hash_mask"))) == bucket_of(F.col("shared_hash")).bitwiseAND(bucket_of(F.col("hash_mask"))))
    return masks.select("source", F.explode(inside).alias("bucket"))


def may_hold(masks: DataFrame, h) -> DataFrame:
    """The sources whose shared hash bits agree with a hash, so the only ones worth reading for it."""
    return masks.where(F.col("hash_mask").bitwiseAND(h) == F.col("shared_hash").bitwiseAND(F.col("hash_mask")))
