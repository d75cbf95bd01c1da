import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keyloom.operators import blocks, lookup, stats
from keyloom.sources.entries import from_pairs


def entries(spark, n=300, size=20):
    rng = random.Random(n)
    return from_pairs(spark, {f"key{i}": "v" * rng.randrange(size) for i in range(n)})


def pairs(df):
    return sorted((bytes(r["key"]), bytes(r["value"])) for r in df.collect())


@pytest.mark.parametrize("codec", sorted(blocks.PACKERS))
def test_roundtrip(spark, codec):
    rows = entries(spark)
    coded = blocks.encode_blocks(rows, 2, 512, codec)
    assert pairs(blocks.decode_blocks(coded)) == sorted((r["key"].encode(), r["value"].encode()) for r in rows.collect())
    assert coded.agg(F.max("n")).first()[0] <= 255


def test_large_values_and_many_small_keys(spark):
    big = from_pairs(spark, {"a": "x" * 10_000, "b": "y"})
    assert blocks.encode_blocks(big, 1, 4096).count() <= 2
    small = from_pairs(spark, {str(i): "" for i in range(1000)})
    assert blocks.number_blocks(small, 1, 1 << 30).agg(F.max("block")).first()[0] == 3


def test_corrupt_blocks_raise_or_are_skipped(spark):
    coded = blocks.encode_blocks(entries(spark), 2, 512)
    total = coded.count()
    broken = coded.withColumn("payload", F.when((F.col("shard") == 0) & (F.col("block") == 0), F.unhex(F.lit("00"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="bad checksum"):
        blocks.decode_blocks(broken).collect()
    kept = blocks.decode_blocks(broken, "skip").count()
    told = blocks.validate(broken).first()
    assert (told["blocks"], told["bad_blocks"], told["sound_entries"]) == (total, 1, kept)
    assert told["missing"] == told["entries"] - kept > 0
    empty = blocks.validate(coded.where("false")).first()
    assert (empty["entries"], empty["blocks"], empty["average_bytes"]) == (0, 0, 0.0)


def test_order_and_offsets(spark):
    rows = blocks.in_order(entries(spark), 2, "md5_32")
    sized = blocks.running_offsets(rows.withColumn("size", F.lit(10)), "shard", ["h", "key"])
    assert sized.groupBy("shard").agg(F.max("offset").alias("m"), F.count("*").alias("n")).where("m <> 10 * (n - 1)").count() == 0


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    assert {r["q"]: r["value"] for r in stats.quantiles(df, "v", (0.5, 1.0)).collect()} == {0.5: 2.5, 1.0: 4.0}
    assert stats.quantiles(df.where("false"), "v", (0.5,)).first()["value"] == 0.0
    assert stats.interpolate([1.0, 2.0, 3.0, 4.0], 0.5) == 2.5 and stats.interpolate([], 0.5) == 0.0
    found = stats.benchmark(lambda: None, 10, 4)
    assert found["throughput"] > 0 and len(found["latencies"]) == 7


def test_read_size(spark):
    row = spark.createDataFrame([(100.0, 16.0, 5), (100.0, None, 1)], "m double, v double, n int")
    assert [r[0] for r in row.select(stats.read_size(F.col("m"), F.col("v"), F.col("n"))).collect()] == [101, 116]


def test_lookups(spark):
    rows = entries(spark, 50).select("key", "value")
    asked = spark.createDataFrame([("key1",), ("key1",), ("none",)], "key string")
    assert lookup.multi_get(rows, asked).count() == 3
    assert lookup.multi_get(rows, asked, "inner").count() == 2
    assert [r[0] for r in lookup.multi_get(rows, asked, "anti").collect()] == ["none"]
    assert lookup.multi_get(rows, asked, "semi").count() == 2
    assert lookup.random_entries(rows, 7, 1).count() == 7
    assert lookup.sample_keys(rows, 5).collect() == lookup.sample_keys(rows.repartition(3), 5).collect()
    with pytest.raises(ValueError):
        lookup.multi_get(rows, asked, "outer")


@pytest.mark.parametrize("size", ["1000", "10m"])
def test_breaks_of_stored_order(spark, tmp_path, size):
    """Files in order, shuffled, and of repeated keys, read whole and in pieces."""
    rng = random.Random(4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ("sorted", "shuffled", "equal"):
            rows = [(rng.randrange(50), f"k{rng.randrange(400)}") for _ in range(2000)]
            rows = sorted(rows) if name == "sorted" else [(1, "k")] * 2000 if name == "equal" else rows
            path = str(tmp_path / name)
            spark.createDataFrame(rows, "h long, key string").coalesce(1).write.option("parquet.block.size", 2000).option("parquet.page.size", 500).parquet(path)
            stored = [tuple(r) for r in pq.ParquetFile(next((tmp_path / name).glob("*.parquet"))).read().to_pandas().values]
            found = blocks.order_breaks(spark.read.parquet(path)).first()
            assert (found["entries"], found["breaks"]) == (2000, sum(b < a for a, b in zip(stored, stored[1:])))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cut_running_totals_equal_whole_ones(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(s, rng.randrange(300), f"k{i}", rng.randrange(9)) for i in range(500) for s in (0, 1)], "shard int, h long, key string, size long")
    cut = F.shiftrightunsigned("h", 4)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert same(blocks.running_offsets(rows, "shard", ["h", "key"]), blocks.running_offsets(rows, "shard", ["h", "key"], cut=cut))
    assert same(blocks.hash_ordinals(rows, "shard"), blocks.hash_ordinals(rows, "shard", cut))


def test_one_block(spark):
    coded = blocks.encode_blocks(entries(spark), 2, 512)
    told = {(r["shard"], r["block"]): r["n"] for r in coded.collect()}
    assert all(blocks.read_block(coded, *place).count() == n for place, n in list(told.items())[:3])
    assert blocks.read_block(coded, 9, 9).count() == 0


def test_quantiles_against_numpy(spark):
    rng = random.Random(6)
    values = [rng.choice([1.0, 2.5, rng.random() * 100]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    found = {r["q"]: r["value"] for r in stats.quantiles(df, "v").collect()}
    assert all(v == pytest.approx(np.quantile(values, q)) for q, v in found.items())
