"""Stores: immutable, hash-sharded, sorted key/value sets in Parquet, with a manifest.

Layout: `<path>/v<number>/entries/shard=N/*.parquet`, sorted by (h, key) in each file and with Bloom filters on the key, and
`<path>/v<number>/manifest`, one row a shard, written last. The highest number with a whole manifest is the store; older ones go when a
newer is whole. So a build that breaks off leaves the store as it was, and a store may be built of its own entries. What lies
there must agree with the manifest in number and size of files, or it isn't a store.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import CODECS, hash_of, lookup, shard_bits, shard_of
from ..functions.text import entry_bytes
from ..operators.lookup import BROADCAST_KEYS
from ..operators.merge import dedupe, fold, last_wins, stack
from ..operators.stats import agreeing_bits
from ..session import Files

FORMAT = "keyloom-2"
MANIFEST = ["format", "hash", "codec", "block_size", "shards", "key_type", "value_type", "files", "file_bytes", "shard", "entries", "bytes", "shared_hash", "hash_mask"]
#: Bytes of entries that are compressed together: the pages of the Parquet files.
BLOCK_SIZE = 1 << 20


def build(
    entries: DataFrame,
    path: str,
    shards: int = 64,
    hash_name: str = "murmur3",
    codec: str = "lz4",
    duplicates: str = "last",
    splits: int = 1,
    block_size: int = BLOCK_SIZE,
) -> Store:
    """Writes a store, in the place of any older one, and opens it.

    One shuffle by hash prefix, then a sort within tasks, which spills. A shard goes to one task, or to `splits`, cut by the
    next bits of the hash. Adaptive execution joins small shares and cuts those beyond its advisory size (64 MiB if not set), so
    a task's share stays that small however much there is, and a shard gets a file from each task that has a part of it;
    with adaptive execution off, only `splits` cuts.
    """
    bits, cut = shard_bits(shards), shard_bits(splits)
    if bits + cut > 32:
        raise ValueError("shards times splits exceeds the hash")
    if block_size < 1:
        raise ValueError(f"the block size must be positive, not {block_size}")
    spark, files = entries.sparkSession, Files(entries.sparkSession, path)
    parquet_codec = lookup(CODECS, "compressor", codec)
    h = hash_of(F.col("key"), hash_name)
    rows = dedupe(entries, duplicates).withColumn("h", h).withColumn("shard", shard_of(F.col("h"), shards))
    shares = rows.withColumn("share", shard_of(F.col("h"), shards * splits)).hint("rebalance", "share").drop("share")
    laid = shares.sortWithinPartitions("shard", "h", "key")
    there = _versions(files, path)
    place = f"{path}/v{max(there, default=0) + 1:09d}"
    writer = laid.drop("h").write.partitionBy("shard").option("compression", parquet_codec).option("parquet.page.size", block_size)
    writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.page.write-checksum.enabled", "true").parquet(f"{place}/entries")
    kinds = [rows.schema[n].dataType.simpleString() for n in ("key", "value")]
    written = _entries(spark, place, *kinds).withColumn("h", h)
    # one pass over the written keys and values gives all that the manifest tells
    facts = written.groupBy("shard").agg(
        F.count("*").alias("entries"),
        F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("bytes"),
        F.bit_and("h").alias("shared_hash"),
        agreeing_bits(F.bit_and("h"), F.bit_or("h")).alias("hash_mask"),
    )
    count, size = files.totals(f"{place}/entries")
    settings = [FORMAT, hash_name, codec, block_size, shards, *kinds, count, size]
    settings = [F.lit(v).cast("long").alias(n) if n in ("files", "file_bytes") else F.lit(v).alias(n) for n, v in zip(MANIFEST, settings)]
    told = facts.select(*settings, "shard", "entries", "bytes", "shared_hash", "hash_mask")
    zero = F.lit(0).cast("long")
    none = spark.range(1).select(*settings, F.lit(-1).alias("shard"), *[zero.alias(n) for n in ("entries", "bytes", "shared_hash", "hash_mask")])
    # the row of shard -1 keeps the settings of a store without entries
    told.unionByName(none).coalesce(1).write.parquet(f"{place}/manifest")
    for number in there:
        files.delete(f"{path}/v{number:09d}")
    return open_store(spark, path)


def _versions(files: Files, path: str) -> list[int]:
    return [int(name[1:]) for name in files.names(path) if name[:1] == "v" and name[1:].isdigit()]


def _entries(spark: SparkSession, place: str, key: str, value: str) -> DataFrame:
    return spark.read.schema(f"key {key}, value {value}, shard int").option("parquet.page.verify-checksum.enabled", "true").parquet(f"{place}/entries")


def is_store(spark: SparkSession, path: str) -> bool:
    """Whether a complete store lies there; any error means no."""
    try:
        open_store(spark, path)
        return True
    except Exception:  # noqa: BLE001
        return False


def open_store(spark: SparkSession, path: str, cached: bool = False) -> Store:
    """Opens a store, whose files must be those that its manifest tells of; with `cached` its entries stay in memory after
    the first read, with the same results, until it is closed."""
    files = Files(spark, path)
    whole = [n for n in _versions(files, path) if files.exists(f"{path}/v{n:09d}/manifest/_SUCCESS")]
    if not whole:
        raise OSError(f"no store at {path}")
    place = f"{path}/v{max(whole):09d}"
    row = spark.read.parquet(f"{place}/manifest").first()
    if row is None or row.__fields__ != MANIFEST or row["format"] != FORMAT:
        raise OSError(f"no store of format {FORMAT} at {path}")
    if files.totals(f"{place}/entries") != (row["files"], row["file_bytes"]):
        raise OSError(f"the store at {path} lacks entries, or has some that aren't its own")
    store = Store(spark, path, place, row["hash"], row["codec"], row["shards"], row["block_size"], row["key_type"], row["value_type"])
    if cached:
        store.rows().cache()
    return store


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    place: str
    hash: str
    codec: str
    shards: int
    block_size: int
    key_type: str
    value_type: str

    def manifest(self) -> DataFrame:
        """One row a shard that has entries."""
        return self.spark.read.parquet(f"{self.place}/manifest").where("shard >= 0")

    @cached_property
    def masks(self) -> dict[int, tuple[int, int]]:
        """For each shard that has entries the bits that its hashes share, and which bits these are: one row a shard, held by the driver."""
        return {r["shard"]: (r["shared_hash"], r["hash_mask"]) for r in self.manifest().select("shard", "shared_hash", "hash_mask").collect()}

    def may_hold(self, h: int) -> bool:
        """Whether a key of this hash can be here, as the masks tell without a read."""
        shared, mask = self.masks.get(h >> (32 - shard_bits(self.shards)), (0, -1))
        return mask >= 0 and h & mask == shared & mask

    def rows(self, on_corrupt: str = "raise") -> DataFrame:
        """key, value and shard; files that can't be read raise an error or are skipped."""
        if on_corrupt not in ("raise", "skip"):
            raise ValueError(f"on_corrupt must be raise or skip, not {on_corrupt!r}")
        reader = self.spark.read.schema(f"key {self.key_type}, value {self.value_type}, shard int")
        return reader.option("ignoreCorruptFiles", str(on_corrupt == "skip").lower()).parquet(f"{self.place}/entries")

    def close(self) -> None:
        """Gives back the memory of a cached store."""
        self.rows().unpersist()

    def entries(self, on_corrupt: str = "raise") -> DataFrame:
        return self.rows(on_corrupt).select("key", "value")

    def keys(self) -> DataFrame:
        return self.rows().select("key")

    def paths(self) -> list[str]:
        return self.rows().inputFiles()

    def lookup(self, key: str | bytes) -> DataFrame:
        """The rows of a key. The shard is worked out from the literal, so one partition is read and the key pushed down."""
        literal = F.lit(key)
        return self.rows().where((F.col("shard") == shard_of(hash_of(literal, self.hash), self.shards)) & (F.col("key") == literal)).select("value")

    def get(self, key: str | bytes) -> str | bytes | None:
        row = self.lookup(key).first()
        return None if row is None else bytes(row[0]) if isinstance(row[0], bytearray) else row[0]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the asked keys that are there.

        A few keys are broadcast, after a count that stops at the bound, and prune the shards they don't name; many meet
        the entries in a shuffle.
        """
        asked = keys.select("key").withColumn("shard", shard_of(hash_of(F.col("key"), self.hash), self.shards))
        if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            asked = F.broadcast(asked)
        return self.rows().join(asked, ["shard", "key"]).select("key", "value")


def merge_stores(stores: list[Store], path: str, f=None, **options) -> Store:
    """Stores merged into a new one, which may take the place of one of them: the last one wins, or f folds the values, newest first."""
    parts = [s.entries() for s in stores]
    return build(last_wins(*parts) if f is None else fold(stack(*parts), f), path, duplicates="keep", **options)
