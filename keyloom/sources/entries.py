"""Entries: DataFrames with the columns key, value, src (position of the source) and ord (order within it)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["key", "value", "src", "ord"]
TEXT_SCHEMA = T.StructType([T.StructField(n, T.StringType(), False) for n in ("key", "value")])
BYTE_SCHEMA = T.StructType([T.StructField(n, T.BinaryType(), False) for n in ("key", "value")])


def to_entries(df: DataFrame, key: str | Column, value: str | Column, order: str | Column | None = None, src: int = 0) -> DataFrame:
    """Entries of any DataFrame. Key and value keep string or binary type, others become text; null is refused.

    Without an order all rows of the source rank alike, and of equal keys the greatest value counts as the last.
    """
    column = lambda x: F.col(x) if isinstance(x, str) else x
    ranked = F.lit(0).cast("long") if order is None else column(order).cast("long")
    out = df.select(column(key).alias("key"), column(value).alias("value"), F.lit(src).alias("src"), ranked.alias("ord"))
    for name in ("key", "value"):
        if not isinstance(out.schema[name].dataType, (T.StringType, T.BinaryType)):
            out = out.withColumn(name, F.col(name).cast("string"))
        if out.schema[name].nullable:
            out = out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"an entry's {name} is null"))).otherwise(F.col(name)))
    return out


def from_pairs(spark: SparkSession, pairs: Mapping | Iterable[tuple], src: int = 0) -> DataFrame:
    """Entries of a mapping or of pairs, in their order; str and bytes both do, but not mixed."""
    rows = list(pairs.items()) if isinstance(pairs, Mapping) else list(pairs)
    binary = any(isinstance(x, (bytes, bytearray)) for row in rows for x in row)
    kind = BYTE_SCHEMA if binary else TEXT_SCHEMA
    as_bytes = lambda x: x.encode() if isinstance(x, str) else bytes(x)
    data = [(*((as_bytes(x) if binary else x) for x in row), i) for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, T.StructType([*kind.fields, T.StructField("ord", T.LongType(), False)]))
    return df.select("key", "value", F.lit(src).alias("src"), "ord")


def binary_entries(df: DataFrame, src: int = 0) -> DataFrame:
    """Entries of a DataFrame whose key and value are binary already; any other type is an error."""
    for name in ("key", "value"):
        if not isinstance(df.schema[name].dataType, T.BinaryType):
            raise TypeError(f"{name} must be binary, not {df.schema[name].dataType.simpleString()}")
    return to_entries(df, "key", "value", src=src)


def same_entries(a: DataFrame, b: DataFrame) -> bool:
    """Whether two DataFrames hold the same bag of keys and values."""
    a, b = a.select("key", "value"), b.select("key", "value")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
