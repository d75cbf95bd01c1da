"""Command line: build, merge, get, keys, decode, validate, benchmark.

    python -m keyloom.cli build INPUT... STORE      text files or stores, later ones win
    python -m keyloom.cli merge STORE... STORE      stores only, the right-most one wins
    python -m keyloom.cli get KEY STORE...          exit status 1 without a matching key
    python -m keyloom.cli keys|decode STORE...      entries on standard output
    python -m keyloom.cli validate|benchmark STORE...
"""

from __future__ import annotations

import argparse
import random
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import decode_base64
from .operators.lookup import sample_keys
from .operators.merge import last_wins
from .operators.stats import benchmark, counts
from .sources.delimited import format_lines, from_stdin, read_delimited
from .sources.store import BLOCK_SIZE, build, is_store, merge_stores, open_store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["build", "merge", "get", "keys", "decode", "validate", "benchmark"])
    p.add_argument("args", nargs="+")
    p.add_argument("-d", "--delimiter", default="\t")
    p.add_argument("-b", "--base64", action="store_true")
    p.add_argument("-n", "--num-reads", type=lambda x: int(float(x)), default=100)
    p.add_argument("-s", "--shards", type=int, default=64)
    p.add_argument("--compressor", default="lz4")
    p.add_argument("--hash", default="murmur3")
    p.add_argument("--block-size", type=int, default=BLOCK_SIZE, help="bytes of entries that are compressed together")
    p.add_argument("--cache", action="store_true", help="keep entries in memory")
    return p


def source(spark: SparkSession, path: str, o: argparse.Namespace) -> DataFrame:
    if path == "-":
        return from_stdin(spark, o.delimiter, o.base64)
    if is_store(spark, path):
        return open_store(spark, path, o.cache).entries()
    return read_delimited(spark, path, o.delimiter, o.base64)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    o = parser().parse_args(argv)
    out = out or sys.stdout
    spark = spark or SparkSession.builder.appName("keyloom").getOrCreate()
    options = {"shards": o.shards, "codec": o.compressor, "hash_name": o.hash, "block_size": o.block_size}
    try:
        if o.command in ("build", "merge"):
            *inputs, target = o.args
            if not inputs:
                raise ValueError("no inputs")
            if o.command == "merge":
                merge_stores([open_store(spark, p) for p in inputs], target, **options)
            else:
                build(last_wins(*[_typed(source(spark, p, o), o) for p in inputs]), target, duplicates="keep", **options)
            return 0
        key, paths = (o.args[0], o.args[1:]) if o.command == "get" else (None, o.args)
        if missing := [p for p in paths if not is_store(spark, p)]:
            raise OSError(f"not a store: {', '.join(missing)}")
        stores = [open_store(spark, p, o.cache) for p in paths]
        if o.command == "get":
            kind = stores[0].rows().schema["key"].dataType.typeName() if stores else "string"
            wanted = spark.range(1).select(decode_base64(F.lit(key)) if o.base64 else F.lit(key)).first()[0]
            wanted = bytes(wanted) if isinstance(wanted, bytearray) else wanted.encode() if kind == "binary" else wanted
            for store in reversed(stores):
                value = store.get(wanted)
                if value is not None:
                    row = spark.createDataFrame([(wanted, value)], "key binary, value binary" if isinstance(value, bytes) else "key string, value string")
                    print(format_lines(row.select(F.col("value").alias("key"), "value"), keys_only=True, base64=o.base64).first()[0], file=out)
                    return 0
            print("no matching key", file=sys.stderr)
            return 1
        if o.command in ("keys", "decode"):
            merged = stores[0].entries() if len(stores) == 1 else last_wins(*[s.entries() for s in stores])
            for row in format_lines(merged, o.delimiter, o.base64, o.command == "keys").toLocalIterator():
                print(row[0], file=out)
        elif o.command == "validate":
            total = [0, 0, 0]
            for store in stores:
                told = store.manifest().agg(F.sum("entries"), F.sum("bytes")).first()
                seen = counts(store.entries("skip")).first()
                n, missing = seen["entries"] if seen else 0, (told[0] or 0) - (seen["entries"] if seen else 0)
                print(f"{store.path}: {n} entries, {(told[1] or 0)} bytes, " + (f"{missing} entries missing" if missing else "nothing missing"), file=out)
                total = [a + b for a, b in zip(total, (n, told[1] or 0, missing))]
            if len(stores) > 1:
                print(f"all {len(stores)}: {total[0]} entries, {total[1]} bytes, " + (f"{total[2]} entries missing" if total[2] else "nothing missing"), file=out)
        else:
            # each read asks a store at random for one of its own keys
            keys = [(store, _plain(r[0])) for store in stores for r in sample_keys(store.entries(), 100).collect()]
            chance = random.Random(1)
            readers = 1
            while readers <= 128 and keys:
                found = benchmark(lambda: (lambda pair: pair[0].get(pair[1]))(chance.choice(keys)), o.num_reads, readers)
                print(f"{readers} reader(s): {found['throughput']:.2f} reads/s; ms: " + ", ".join(f"{q:.1%} {v:.2f}" for q, v in found["latencies"]), file=out)
                readers *= 2
        return 0
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


def _typed(entries: DataFrame, o: argparse.Namespace) -> DataFrame:
    """All sources of one build share a type: bytes if any may hold bytes."""
    return entries.withColumn("key", F.col("key").cast("binary")).withColumn("value", F.col("value").cast("binary")) if o.base64 else entries


def _plain(key):
    return bytes(key) if isinstance(key, bytearray) else key


if __name__ == "__main__":
    sys.exit(main())
