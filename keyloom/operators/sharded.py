"""Shards as bucketed tables: merges of tables with the same buckets need no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_of, shard_of


def of_shard(entries: DataFrame, shard: int, shards: int, hash_name: str = "murmur3") -> DataFrame:
    """The entries of one shard."""
    return entries.where(shard_of(hash_of(F.col("key"), hash_name), shards) == shard)


def save_bucketed(entries: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by key, for merges and joins in place; at a path, or in the warehouse."""
    writer = entries.select("key", "value").repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def merge_bucketed(spark: SparkSession, *tables: str) -> DataFrame:
    """Last-wins merge of tables with the same number of buckets and one row a key, bucket by bucket where they lie, without a shuffle.

    Each table gives the entries whose keys no newer one has. That reads the keys of a table once for each older one, which
    suits a few tables.
    """
    parts = [spark.table(name).select("key", "value") for name in tables]
    newest = []
    for i, part in enumerate(parts):
        for newer in parts[i + 1 :]:
            part = part.join(newer.select("key").hint("merge"), "key", "left_anti")
        newest.append(part)
    return reduce(DataFrame.unionByName, newest)


def assign_paths(files: DataFrame, shards: int) -> DataFrame:
    """(source, path, shard): file i of n of a source, in the order of names, belongs to shard floor(i / n * shards)."""
    w = Window.partitionBy("source")
    i = F.row_number().over(w.orderBy("path")) - 1
    n = F.count("*").over(w)
    return files.select("source", "path", F.floor(i * shards / n).cast("int").alias("shard"))
