"""Aggregates about entries and timings: hash masks, validation counts, moments, quantiles, throughput."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import MASK
from ..functions.text import entry_bytes
from ..session import durable

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def hash_mask(hashed: DataFrame, *by: str) -> DataFrame:
    """Bits that all hashes (column h) share: shared_hash, and hash_mask with a 1 where they agree."""
    return hashed.groupBy(*by).agg(F.bit_and("h").alias("shared_hash"), agreeing_bits(F.bit_and("h"), F.bit_or("h")).alias("hash_mask"))


def agreeing_bits(every: Column, some: Column) -> Column:
    """The bits that are alike in all hashes, from their bitwise and, and their bitwise or."""
    return F.bitwise_not(every.bitwiseXOR(some)).bitwiseAND(F.lit(MASK))


def counts(entries: DataFrame, *by: str) -> DataFrame:
    """Entries, distinct keys and bytes."""
    return entries.groupBy(*by).agg(
        F.count("*").alias("entries"),
        F.count_distinct("key").alias("keys"),
        F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("bytes"),
    )


def moments(df: DataFrame, column: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_samp(column).alias("variance"))


def read_size(mean: Column, variance: Column, n: Column) -> Column:
    """Bytes to ask for when reading a block: the mean and a quarter of the deviation (of 4096 before two are known)."""
    spread = F.when(n <= 1, F.lit(4096.0)).otherwise(variance)
    return F.floor(mean + F.sqrt(spread) / 4).cast("long")


def quantiles(df: DataFrame, column: str, qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(q, value): exact quantiles by linear interpolation; 0 for an empty column.

    Values are counted and sorted by range. The driver holds one count a range and finds in which ranges the wanted ranks fall;
    running counts within these give the two values next to each quantile.
    """
    spark = df.sparkSession
    counted = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    ranged = durable(counted.repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("range").agg(F.sum("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return spark.createDataFrame([(q, 0.0) for q in qs], "q double, value double")
    begins, at = [], 0
    for name, n in sizes:
        begins.append((name, at, n))
        at += n
    wanted = {q: (total - 1) * q for q in qs}
    ranks = sorted({r for place in wanted.values() for r in (int(place), min(int(place) + 1, total - 1))})
    inside = [(name, begin, [r - begin for r in ranks if begin <= r < begin + n]) for name, begin, n in begins]
    asked = spark.createDataFrame([(name, r, begin + r) for name, begin, rs in inside for r in rs], "range int, rank long, place long")
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    running = ranged.where(F.col("range").isin([name for name, _, rs in inside if rs])).withColumn("upto", upto)
    met = running.join(F.broadcast(asked), "range").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    value = {r["place"]: r["v"] for r in met.select("place", "v").collect()}
    rows = []
    for q, place in wanted.items():
        low, high = value[int(place)], value[min(int(place) + 1, total - 1)]
        rows.append((q, low + (high - low) * (place - int(place))))
    return spark.createDataFrame(rows, "q double, value double")


def throughput(df: DataFrame, ts: str) -> DataFrame:
    """Rows a second between the first and the last timestamp."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.max(micros) - F.min(micros)
    return df.agg((F.count("*") / (span / 1e6)).alias("per_second"))


def benchmark(read: Callable[[], object], reads: int, readers: int) -> dict[str, float | list[tuple[float, float]]]:
    """Reads a second and latency quantiles in milliseconds of a read repeated by so many concurrent readers."""
    each = [reads // readers + (i < reads % readers) for i in range(readers)]

    def work(n: int) -> list[float]:
        out = []
        for _ in range(n):
            began = time.perf_counter()
            read()
            out.append((time.perf_counter() - began) * 1e3)
        return out

    began = time.perf_counter()
    with ThreadPoolExecutor(readers) as pool:
        latencies = sorted(x for part in pool.map(work, each) for x in part)
    took = time.perf_counter() - began
    return {"throughput": len(latencies) / took if took else 0.0, "latencies": [(q, interpolate(latencies, q)) for q in QUANTILES]}


def interpolate(ordered: list[float], q: float) -> float:
    if not ordered:
        return 0.0
    at = (len(ordered) - 1) * q
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)
