"""Plumbing that the text operators share: table access, Arrow batch maps, durable cuts of lineage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, shared_folder  # noqa: F401

#: Bytes of a text that separate words in the `[^\x20\x09-\x0D]+` sense; bytes.split() splits at exactly these.
SPACES = b" \t\n\r\x0b\x0c"

#: Lower-cases A-Z and turns every byte outside [0-9a-z\x80-\xFF] into a blank, so that split() yields
#: the words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` over a lower-cased text.
ALNUM = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)

Columns = dict[str, object]

#: Bytes of texts that a worker lays out at once, where it goes through batches in strides.
STRIDE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number for each row, written so that it stays the same, and the number's column."""
    row = fresh(df, "row")
    return durable(df.withColumn(row, F.monotonically_increasing_id())), row


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a detour over str."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def strides(batches: Iterator[pa.RecordBatch], most: int = STRIDE) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have up to so many bytes, or of one row.

    A batch has 10,000 rows however long their texts are; what a worker and the JVM hold of it besides the batch itself,
    and keep from there on, is so bounded by the stride.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = done = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(ends[end - 1])


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Columns]], in_strides: bool = False) -> DataFrame:
    """Runs make() once in each task and its result on each Arrow batch, or its strides; it returns the columns named in schema."""
    names = [part.split()[0].strip("`") for part in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in strides(batches) if in_strides else batches:
            out = work(batch)
            yield pa.RecordBatch.from_arrays([as_array(out[name]) for name in names], names=names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """Splits a DDL string at its top-level commas."""
    parts, depth, last = [], 0, 0
    for at, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:at])
            last = at + 1
    return [*parts, schema[last:]]


def as_array(values: object) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def replace_text(batch: pa.RecordBatch, texts: list[str | None], keep: list[bool] | np.ndarray | None = None) -> pa.RecordBatch:
    """The batch with another text column, and only the rows to keep; all other columns pass untouched."""
    at = batch.schema.get_field_index("text")
    columns = batch.columns
    columns[at] = pa.array(texts, type=batch.schema.field(at).type)
    out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return out if keep is None else out.filter(pa.array(np.asarray(keep, dtype=bool)))


def remainder(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo modulus; -1 for a null id, which so belongs to no held-out fold."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids.to_pylist()], dtype=np.int64)


def fold(column: str, modulus: int):
    """remainder() as a column expression."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
