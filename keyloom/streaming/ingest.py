"""Ingest of delimited text as it arrives: each micro-batch becomes one more source, the newest, of a folder of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import SourceSet
from ..session import Files
from ..sources.delimited import parse_lines
from ..sources.store import build, is_store, open_store


def ingest(spark: SparkSession, incoming: str, stores: str, checkpoint: str, delimiter: str = "\t", shards: int = 16) -> StreamingQuery:
    """Starts a query that ends when all files at hand are read.

    A batch is written under its number, so one that runs again after a failure replaces itself. Within a file of a
    batch the last line of a key wins.
    """
    lines = spark.readStream.text(incoming)

    def add(batch: DataFrame, number: int) -> None:
        ordered = batch.select("value", F.monotonically_increasing_id().alias("ord"))
        build(parse_lines(ordered, delimiter), f"{stores}/batch-{number:012d}", shards=shards)

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, stores: str, names: list[str] | None = None) -> SourceSet:
    """The set of all ingested batches, later ones ranking higher."""
    found = SourceSet()
    for name in sorted(names if names is not None else Files(spark, stores).names(stores)):
        if is_store(spark, f"{stores}/{name}"):
            found = found.add(name, open_store(spark, f"{stores}/{name}"))
    return found
