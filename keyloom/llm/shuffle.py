"""A uniform global shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in input partitions of known sizes; output positions are cut into blocks, a shard being one or more
blocks in a row. How many rows of each partition go to each block is drawn from the multivariate hypergeometric law that
a uniform permutation has, so sizes come out exact. Each partition then permutes its rows locally and deals them out
by its row of the matrix, the blocks are exchanged, and each block is permuted again.

The matrix is never held as a whole: it is drawn down a binary tree over the partitions, each node splitting its
block counts between its halves with a generator of its own seed. A task draws only the nodes above its partition, and
draws them alike when it runs again elsewhere. The driver knows one count a partition.

Law `rows`: shard sizes are at most one apart. Equal texts are no reason to share a shard: the shuffle is uniform over
rows.

Defined results: repeated rows and null ids are rows like any other; a null text has size 1 and the CRC-32 of nothing,
0; an empty table gives an empty result; shards beyond the number of rows stay empty. Other columns, of whatever
name, travel along in `shuffle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import durable

SHARDS, SEED, BLOCK_ROWS = 8, 20240501, 1 << 20
#: Population beyond which numpy's generator draws no hypergeometric numbers.
NUMPY_LIMIT = 10**9 - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows taken without replacement are among the good ones."""
    if good + bad <= NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad else 0
    low, high = max(0, draws - bad), min(draws, good)
    mean = draws * (good / (good + bad))
    spread = (mean * (bad / (good + bad)) * max(0.0, (good + bad - draws) / (good + bad - 1))) ** 0.5
    # inversion over 40 deviations around the mean, from ratios of neighbouring probabilities; the rest weighs below 1e-300
    low, high = max(low, int(mean - 40 * spread) - 2), min(high, int(mean + 40 * spread) + 2)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    total = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def split(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of the drawn rows come from each of the counts."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i, count in enumerate(counts.tolist()):
        if not draws:
            break
        left -= count
        out[i] = taken = hypergeometric(rng, count, left, draws)
        draws -= taken
    return out


def matrix_row(sizes: np.ndarray, blocks: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """The partition's row of the communication matrix: how many of its rows go to each block."""
    ahead = np.concatenate(([0], np.cumsum(sizes)))
    low, high, counts = 0, len(sizes), blocks.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng((seed, low, high)), counts, int(ahead[middle] - ahead[low]))
        low, high, counts = (low, middle, left) if partition < middle else (middle, high, counts - left)
    return counts


def block_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, shard) of each block: shard sizes are at most one apart, and so are those of a shard's blocks."""
    per_shard = [rows // shards + (s < rows % shards) for s in range(shards)]
    sizes, owner = [], []
    for shard, n in enumerate(per_shard):
        parts = max(1, -(-n // block_rows))
        sizes += [n // parts + (p < n % parts) for p in range(parts)]
        owner += [shard] * parts
    return np.array(sizes, dtype=np.int64), np.array(owner, dtype=np.int64)


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of df with shard and slot (from 0, gapless within its shard) added.

    df's own columns come nested in `row`, so none can clash.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    # written once: its partitions hold the same rows in the same order whenever a task reads them again
    rows = durable(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")))
    count = {r[0]: r[1] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    sizes = np.array([count.get(p, 0) for p in range(max(count, default=0) + 1)], dtype=np.int64)
    blocks, owner = block_sizes(int(sizes.sum()), shards, block_rows)
    starts = np.cumsum(blocks) - blocks
    starts -= np.array([starts[np.searchsorted(owner, s)] for s in owner.tolist()], dtype=np.int64)
    plan = df.sparkSession.sparkContext.broadcast((sizes, blocks, owner, starts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, blocks, owner, starts = plan.value
        partition, at, deck = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if deck is None:
                rng = np.random.default_rng((seed, 1 << 40, partition))
                deck = rng.permutation(np.repeat(np.arange(len(blocks), dtype=np.int32), matrix_row(sizes, blocks, partition, seed)))
            block = deck[at : at + batch.num_rows]
            again = rng.integers(-(1 << 63), 1 << 63, batch.num_rows, dtype=np.int64)
            order = (partition << 40) + np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            added = [block, owner[block].astype(np.int32), starts[block], again, order]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=["row", "block", "shard", "start", "again", "order"])

    kinds = [("block", T.IntegerType()), ("shard", T.IntegerType()), ("start", T.LongType()), ("again", T.LongType()), ("order", T.LongType())]
    dealt = rows.mapInArrow(deal, T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in kinds]]))
    place = F.row_number().over(Window.partitionBy("block").orderBy("again", "order")) - 1
    return dealt.select("row", "shard", (F.col("start") + place).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle(facts, shards, seed, block_rows).select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
