"""Blocks: entries in hash order, packed, compressed and checksummed in rows of their own."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_of, shard_of
from ..functions.text import entry_bytes

BLOCK_SIZE, MAX_HASHES = 4096, 255


def _sized(codec: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """An Arrow codec; the size of what was compressed comes first, in four bytes."""
    pack = lambda b: struct.pack(">I", len(b)) + pa.compress(b, codec, asbytes=True)
    return pack, lambda b: pa.decompress(b[4:], struct.unpack(">I", b[:4])[0], codec, asbytes=True)


PACKERS = {
    "none": (bytes, bytes),
    "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress),
    "zlib": (zlib.compress, zlib.decompress),
    **{codec: _sized(codec) for codec in ("lz4", "snappy", "zstd")},
}


def in_order(entries: DataFrame, shards: int, hash_name: str = "murmur3") -> DataFrame:
    """Entries with h and shard, each shard within one task and sorted by (h, key)."""
    hashed = entries.withColumn("h", hash_of(F.col("key"), hash_name)).withColumn("shard", shard_of(F.col("h"), shards))
    return hashed.repartition("shard").sortWithinPartitions("shard", "h", "key")


class Packer:
    """Assigns block numbers to entries in order.

    A block is closed once it has 255 hashes or its entries sum up to the block size; entries of one hash stay together.
    """

    def __init__(self, block_size: int = BLOCK_SIZE, max_hashes: int = MAX_HASHES):
        self.limit, self.most = block_size, max_hashes
        self.shard = self.h = None
        self.block = self.hashes = self.size = 0

    def place(self, shard: int, h: int, size: int) -> int:
        if shard != self.shard:
            self.shard, self.h, self.block, self.hashes, self.size = shard, h, 0, 1, 0
        elif h != self.h:
            self.h = h
            if self.hashes >= self.most or self.size >= self.limit:
                self.block, self.hashes, self.size = self.block + 1, 0, 0
            self.hashes += 1
        self.size += size
        return self.block


def number_blocks(entries: DataFrame, shards: int = 4, block_size: int = BLOCK_SIZE, hash_name: str = "murmur3") -> DataFrame:
    """Entries with h, shard and block; entries stream through in order, no shard is ever held whole."""
    rows = in_order(entries.select("key", "value"), shards, hash_name).withColumn("size", entry_bytes(F.col("key"), F.col("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(block_size)
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            placed = map(packer.place, columns[3].to_pylist(), columns[2].to_pylist(), batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(placed), pa.int64())], names=["key", "value", "h", "shard", "block"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, value {rows.schema['value'].dataType.simpleString()}, h long, shard int, block long")


def encode_block(pairs: list[tuple[int, bytes, bytes]]) -> bytes:
    """One block's bytes: the number of hashes, the offset of each hash's first entry, then length-prefixed keys and values."""
    body, offsets, last = [], [], None
    for h, key, value in pairs:
        if h != last:
            offsets.append(sum(map(len, body)))
            last = h
        body.append(struct.pack(">I", len(key)) + key + struct.pack(">I", len(value)) + value)
    head = 1 + 4 * len(offsets)
    return bytes([len(offsets)]) + b"".join(struct.pack(">I", head + o) for o in offsets) + b"".join(body)


def decode_block(data: bytes) -> list[tuple[bytes, bytes]]:
    at, out = 1 + 4 * data[0], []
    while at < len(data):
        pair = []
        for _ in range(2):
            (size,) = struct.unpack_from(">I", data, at)
            pair.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        out.append((pair[0], pair[1]))
    return out


BLOCKS = "shard int, block long, n long, codec string, checksum long, payload binary"


def encode_blocks(entries: DataFrame, shards: int = 4, block_size: int = BLOCK_SIZE, codec: str = "lz4", hash_name: str = "murmur3") -> DataFrame:
    """Rows (shard, block, n, codec, checksum, payload); the checksum is of the compressed bytes."""
    if codec not in PACKERS:
        raise ValueError(f"unknown block codec {codec!r}; known: {', '.join(PACKERS)}")
    rows = in_order(entries.select(F.col("key").cast("binary"), F.col("value").cast("binary")), shards, hash_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, packer, held, at = PACKERS[codec][0], Packer(block_size), [], None

        def batch_of(blocks):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["shard", "block", "n", "codec", "checksum", "payload"])

        def close():
            payload = pack(encode_block(held))
            return (*at, len(held), codec, zlib.crc32(payload), payload)

        for batch in batches:
            done = []
            for key, value, h, shard in zip(*(batch.column(i).to_pylist() for i in range(4))):
                place = (shard, packer.place(shard, h, len(key) + len(value) + 8))
                if place != at and held:
                    done.append(close())
                    held = []
                at = place
                held.append((h, key, value))
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([close()])

    return rows.mapInArrow(run, BLOCKS)


def with_validity(blocks: DataFrame) -> DataFrame:
    """Blocks with `valid`: whether the payload agrees with its checksum."""
    return blocks.withColumn("valid", F.crc32("payload") == F.col("checksum"))


def decode_blocks(blocks: DataFrame, on_corrupt: str = "raise") -> DataFrame:
    """(key, value) of all blocks; a block that fails its checksum raises an error, or is skipped."""
    checked = with_validity(blocks)
    if on_corrupt == "skip":
        checked = checked.where("valid")
    elif on_corrupt == "raise":
        checked = checked.withColumn("payload", F.when(F.col("valid"), F.col("payload")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad checksum in shard"), "shard", F.lit("block"), "block"))))
    else:
        raise ValueError(f"on_corrupt must be raise or skip, not {on_corrupt!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for data, codec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in decode_block(PACKERS[codec][1](data))]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["key", "value"])

    return checked.select("payload", "codec").mapInArrow(run, "key binary, value binary")


def read_block(blocks: DataFrame, shard: int, block: int) -> DataFrame:
    """(key, value) of one block; a bad checksum raises."""
    return decode_blocks(blocks.where((F.col("shard") == shard) & (F.col("block") == block)))


def validate(blocks: DataFrame) -> DataFrame:
    """One row: entries told by the blocks, entries in sound blocks, blocks, bad blocks, bytes, average bytes a block, missing entries."""
    checked = with_validity(blocks)
    found = checked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("n"))), F.lit(0)).alias("sound_entries"),
        F.count("*").alias("blocks"),
        F.count_if(~F.col("valid")).alias("bad_blocks"),
        F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0)).alias("bytes"),
    )
    average = F.when(F.col("blocks") > 0, F.col("bytes") / F.col("blocks")).otherwise(F.lit(0.0))
    return found.withColumn("average_bytes", average).withColumn("missing", F.col("entries") - F.col("sound_entries"))


def running_offsets(sized: DataFrame, by: str, order: list[str], size: str = "size", cut: Column | None = None) -> DataFrame:
    """Rows with `offset`: what the rows before them in their group sum up to.

    `cut` is a column that never falls along the order, such as leading bits of the hash. Groups are then summed up in the pieces
    that it makes of them, so no task takes a group whole; only the pieces' totals, one row each, meet in one.
    """
    piece = fresh(sized, "piece")
    rows = sized.withColumn(piece, F.lit(0) if cut is None else cut)
    inside = Window.partitionBy(by, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("long")
    if cut is None:
        return rows.withColumn("offset", offset).drop(piece)
    before = _before(rows.groupBy(by, piece).agg(F.sum(size).alias("total")), by, piece)
    return rows.withColumn("offset", offset).join(before, [by, piece]).withColumn("offset", F.col("offset") + F.col("before")).drop(piece, "before")


def _before(totals: DataFrame, by: str, piece: str) -> DataFrame:
    """(by, piece, before): the totals of the pieces before."""
    w = Window.partitionBy(by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(by, piece, F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long").alias("before"))


def hash_ordinals(hashed: DataFrame, by: str, cut: Column | None = None) -> DataFrame:
    """Rows with `ordinal`: the place of their hash among the hashes of their group; `cut` as in `running_offsets`."""
    piece = fresh(hashed, "piece")
    rows = hashed.withColumn(piece, F.lit(0) if cut is None else cut)
    ordinal = (F.dense_rank().over(Window.partitionBy(by, piece).orderBy("h")) - 1).cast("long")
    if cut is None:
        return rows.withColumn("ordinal", ordinal).drop(piece)
    before = _before(rows.select(by, piece, "h").distinct().groupBy(by, piece).agg(F.count("*").alias("total")), by, piece)
    return rows.withColumn("ordinal", ordinal).join(before, [by, piece]).withColumn("ordinal", F.col("ordinal") + F.col("before")).drop(piece, "before")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def order_breaks(stored: DataFrame, *by: str) -> DataFrame:
    """Per group of files (columns `by` of the scan) entries, and how many of them are less by (h, key) than the one stored before them in their file.

    `stored` reads files and has h and key. Rows stream by in the order in which they are stored; each piece of a
    file that a task reads gives one row, and these meet where pieces do.
    """
    rows = stored.select(*by, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), "h", "key")
    key = rows.schema["key"].dataType.simpleString()
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in by)
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                path, at, this = row[n], row[n + 1], row[n + 2 :]
                if now is not None and (path != now[n] or at != now[n + 1] + now[n + 2]):
                    yield _piece(now, batch.schema)
                    now = None
                if now is None:
                    now = [*row[: n + 2], 0, 0, *this, *this]
                now[n + 3] += this < tuple(now[-2:])
                now[n + 2] += 1
                now[-2:] = this
            kind = batch.schema
        if now is not None:
            yield _piece(now, kind)

    names = [*by, "path", "at", "entries", "breaks", "first_h", "first_key", "last_h", "last_key"]

    def _piece(row: list, kind: pa.Schema) -> pa.RecordBatch:
        types = [*(kind.field(i).type for i in range(n)), pa.string(), *[pa.int64()] * 3, *[pa.int64(), kind.field(n + 3).type] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    schema = f"{kinds}{', ' if by else ''}path string, at long, entries long, breaks long, first_h long, first_key {key}, last_h long, last_key {key}"
    pieces = rows.mapInArrow(run, schema)
    w = Window.partitionBy("path").orderBy("at")
    last_h, last_key = F.lag("last_h").over(w), F.lag("last_key").over(w)
    bad = F.coalesce((last_h > F.col("first_h")) | ((last_h == F.col("first_h")) & (last_key > F.col("first_key"))), F.lit(False))
    return pieces.withColumn("bad", bad.cast("long")).groupBy(*by).agg(F.sum("entries").alias("entries"), F.sum(F.col("breaks") + F.col("bad")).alias("breaks"))
