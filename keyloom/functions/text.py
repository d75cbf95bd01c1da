"""Text and byte forms of keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bytes(value: Column) -> Column:
    return value.cast("binary")


def to_text(value: Column) -> Column:
    return F.decode(value.cast("binary"), "UTF-8")


def encode_base64(value: Column) -> Column:
    """Base64 on one line and without padding."""
    return F.rtrim(F.regexp_replace(F.base64(value.cast("binary")), "[\r\n]", ""), F.lit("="))


def decode_base64(value: Column) -> Column:
    """Bytes of a Base64 text, padded or not."""
    return F.unbase64(value)


def entry_bytes(key: Column, value: Column) -> Column:
    """Size of an entry on disk: both byte strings and a length of four bytes before each."""
    return (F.octet_length(key) + F.octet_length(value) + 8).cast("long")


def cut_at_first(line: Column, delimiter: str) -> tuple[Column, Column, Column]:
    """(text before the first delimiter, text behind it, whether there is one); without one all is key, and the value empty."""
    at = F.instr(line, delimiter)
    key = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line)
    value = F.when(at > 0, F.substring(line, at + len(delimiter), F.length(line))).otherwise(F.lit(""))
    return key, value, at > 0


def join_line(key: Column, value: Column, delimiter: str) -> Column:
    return F.concat(key, F.lit(delimiter), value)
