"""Merging sources: the last one wins, or values of one key are folded; and sets of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_of
from ..session import durable

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda v: F.sum(v.cast("decimal(38,0)")).cast("string"),
    "min": F.min,
    "max": F.max,
    "count": lambda v: F.count(v).cast("string"),
}
#: Values of one key that an associative fold gathers at once.
CHUNK = 1000


def stack(*sources: DataFrame) -> DataFrame:
    """The union of sources, each one's src set to its place: later ones rank higher."""
    if not sources:
        raise ValueError("no sources")
    placed = [s.select("key", "value", F.lit(i).alias("src"), *(["ord"] if "ord" in s.columns else [F.lit(0).cast("long").alias("ord")])) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, placed)


def latest(entries: DataFrame) -> DataFrame:
    """One entry a key: the one of the largest (src, ord); of equals, the greatest value.

    max_by aggregates before the shuffle, so a hot key sends one row a task.
    """
    return entries.groupBy("key").agg(F.max_by("value", F.struct("src", "ord", "value")).alias("value"))


def last_wins(*sources: DataFrame) -> DataFrame:
    """Merged entries of all sources; where keys meet, the last source's entry stays."""
    return latest(stack(*sources))


def dedupe(entries: DataFrame, duplicates: str = "last") -> DataFrame:
    """Entries with one key, by rule: `last` by ord stays, all are kept (`keep`), or they are an error."""
    if duplicates == "keep":
        return entries.select("key", "value")
    if duplicates == "last":
        return latest(entries)
    if duplicates == "error":
        counted = entries.groupBy("key").agg(F.first("value").alias("value"), F.count("*").alias("n"))
        return counted.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col("key").cast("string")))).otherwise(F.col("key")).alias("key"), "value")
    raise ValueError(f"unknown rule for duplicates: {duplicates!r}")


def fold(entries: DataFrame, f: str | Callable[[Column, Column], Column], associative: bool = False) -> DataFrame:
    """Per key the fold of its values, newest source first: f(f(newest, next), ...).

    f names one of AGGREGATES, which pre-aggregate, or makes a column of two. The values of a key are then
    gathered in an array; if f is associative, only in runs of CHUNK, so that no key is ever gathered whole.
    """
    if isinstance(f, str):
        return entries.groupBy("key").agg(AGGREGATES[f](F.col("value")).alias("value"))
    place = F.struct((-F.col("src")).alias("s"), (-F.col("ord")).alias("o"))
    rows = entries.select("key", "value", place.alias("at"))
    while associative:
        nth = F.row_number().over(Window.partitionBy("key").orderBy("at", F.desc("value"))) - 1
        runs = rows.withColumn("run", F.floor(nth / CHUNK)).withColumn("nth", nth)
        folded = _gather(runs, ["key", "run"], "nth", f).select("key", "value", F.struct(F.col("run").cast("int").alias("s"), F.lit(0).cast("long").alias("o")).alias("at"))
        if folded.groupBy("key").count().where("count > 1").isEmpty():
            return folded.select("key", "value")
        rows = durable(folded)
    return _gather(rows, ["key"], "at", f).select("key", "value")


def _gather(rows: DataFrame, by: list[str], order: str, f: Callable[[Column, Column], Column]) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "value")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))
    values = F.transform(listed, lambda x: x["value"])
    return rows.groupBy(*by).agg(values.alias("vs")).select(*by, F.aggregate(F.slice("vs", 2, F.greatest(F.size("vs"), F.lit(1))), F.element_at("vs", 1), f).alias("value"))


def fold_python(entries: DataFrame, f: Callable[[object, object], object]) -> DataFrame:
    """fold() with a Python function of two values.

    Keys are shuffled and sorted, and each task folds as entries stream by: it holds one value, however many a key has.
    """
    rows = entries.repartition("key").sortWithinPartitions("key", F.desc("src"), F.desc("ord"), F.desc("value")).select("key", "value")
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = value = None
        started = False
        for batch in batches:
            keys, values = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if started and k == key:
                    value = f(value, v)
                else:
                    if started:
                        keys.append(key)
                        values.append(value)
                    key, value, started = k, v, True
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(values, batch.schema.field(1).type)], names=["key", "value"])
            types = [batch.schema.field(i).type for i in (0, 1)]
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([key], types[0]), pa.array([value], types[1])], names=["key", "value"])

    return rows.mapInArrow(run, kinds)


class Keyed(Protocol):
    """What a set asks of a store."""

    spark: SparkSession
    hash: str

    def entries(self) -> DataFrame: ...
    def may_hold(self, h: int) -> bool: ...
    def lookup(self, key: str | bytes) -> DataFrame: ...
    def close(self) -> None: ...


@dataclass(frozen=True)
class SourceSet:
    """An immutable stack of named sources, stores or entries; what was added last has precedence. Adding a name again moves it to the top."""

    sources: tuple[tuple[str, DataFrame | Keyed], ...] = field(default=())

    def add(self, name: str, source: DataFrame | Keyed) -> SourceSet:
        return SourceSet((*self.remove(name).sources, (name, source)))

    def remove(self, name: str) -> SourceSet:
        """The set without a source; what that one covered shows again."""
        return SourceSet(tuple(s for s in self.sources if s[0] != name))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.sources)

    @property
    def next_priority(self) -> int:
        return len(self.sources)

    def stacked(self) -> DataFrame:
        return stack(*[s if isinstance(s, DataFrame) else s.entries() for _, s in self.sources])

    def entries(self) -> DataFrame:
        return latest(self.stacked())

    def candidates(self, key: str | bytes) -> list[str]:
        """The sources that are read for a key: of stores only those whose shared hash bits agree with the key's hash."""
        hashes: dict[str, int] = {}
        found = []
        for name, source in self.sources:
            if not isinstance(source, DataFrame):
                if source.hash not in hashes:
                    # a literal's hash is folded by the optimizer, no job runs
                    hashes[source.hash] = source.spark.sql("VALUES (1)").select(hash_of(F.lit(key), source.hash)).first()[0]
                if not source.may_hold(hashes[source.hash]):
                    continue
            found.append(name)
        return found

    def lookup(self, key: str | bytes) -> DataFrame | None:
        """(value) of a key, from the newest source that has it; None if no source can have it. Of a store one shard is read."""
        asked = set(self.candidates(key))
        parts = []
        for at, (name, source) in enumerate(self.sources):
            if name in asked:
                rows = source.where(F.col("key") == F.lit(key)) if isinstance(source, DataFrame) else source.lookup(key).withColumn("key", F.lit(key))
                order = F.col("ord") if "ord" in rows.columns else F.lit(0).cast("long")
                parts.append(rows.select("key", "value", F.lit(at).alias("src"), order.alias("ord")))
        return latest(reduce(DataFrame.unionByName, parts)).select("value") if parts else None

    def get(self, key: str | bytes) -> str | bytes | None:
        """The value of a key, from the newest source that has it; None without one."""
        found = self.lookup(key)
        row = None if found is None else found.first()
        return None if row is None else bytes(row["value"]) if isinstance(row["value"], bytearray) else row["value"]

    def close(self) -> None:
        for _, source in self.sources:
            source.unpersist() if isinstance(source, DataFrame) else source.close()
