"""Delimited text as a source and a sink of entries."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cut_at_first, decode_base64, encode_base64, join_line, to_text


def parse_lines(lines: DataFrame, delimiter: str = "\t", base64: bool = False, strict: bool = False, src: int = 0) -> DataFrame:
    """Entries of the lines in column `value` (and `ord`, if there is one).

    Empty lines are dropped; a line is cut at its first delimiter, there are no quotes. A line without one is a
    key with an empty value, or an error if `strict`.
    """
    if not delimiter:
        raise ValueError("the delimiter is empty")
    key, value, has = cut_at_first(F.col("value"), delimiter)
    if strict:
        key = F.when(has, key).otherwise(F.raise_error(F.concat(F.lit("no delimiter in line: "), F.col("value"))))
    if base64:
        key, value = decode_base64(key), decode_base64(value)
    order = F.col("ord") if "ord" in lines.columns else F.lit(0).cast("long")
    return lines.where(F.length("value") > 0).select(key.alias("key"), value.alias("value"), F.lit(src).alias("src"), order.alias("ord"))


def read_delimited(spark: SparkSession, paths: str | list[str], delimiter: str = "\t", base64: bool = False, strict: bool = False, src: int = 0) -> DataFrame:
    """Entries of text files or folders. Files whose name starts with _ or . are skipped, as always in Spark.

    A later line of a file counts as the later entry. Between the files of one call the order is fixed but not told by
    their names: where it matters, read them as sources of their own.
    """
    lines = spark.read.text(paths).select("value", F.monotonically_increasing_id().alias("ord"))
    return parse_lines(lines, delimiter, base64, strict, src)


def from_lines(spark: SparkSession, lines: Iterable[str], delimiter: str = "\t", base64: bool = False, strict: bool = False, src: int = 0) -> DataFrame:
    """Entries of lines that the driver holds."""
    rows = [(line.rstrip("\n"), i) for i, line in enumerate(lines)]
    return parse_lines(spark.createDataFrame(rows, "value string, ord long"), delimiter, base64, strict, src)


def from_stdin(spark: SparkSession, delimiter: str = "\t", base64: bool = False, src: int = 0) -> DataFrame:
    return from_lines(spark, sys.stdin, delimiter, base64, src=src)


def format_lines(entries: DataFrame, delimiter: str = "\t", base64: bool = False, keys_only: bool = False) -> DataFrame:
    """One text line an entry, in column `value`."""
    form = encode_base64 if base64 else to_text
    key = form(F.col("key"))
    return entries.select((key if keys_only else join_line(key, form(F.col("value")), delimiter)).alias("value"))


def write_delimited(entries: DataFrame, path: str, delimiter: str = "\t", base64: bool = False) -> None:
    format_lines(entries, delimiter, base64).write.mode("overwrite").text(path)
