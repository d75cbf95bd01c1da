import hashlib
import io
import shutil
import zlib
from collections import Counter
from pathlib import Path

import pytest
import xxhash

from keyloom import cli
from keyloom.functions.hashing import CODECS, HASHES, hash_of, shard_bits
from keyloom.operators import lookup
from keyloom.operators.blocks import order_breaks
from keyloom.operators.merge import SourceSet, fold, last_wins
from keyloom.operators.sharded import merge_bucketed, save_bucketed
from keyloom.sources.delimited import from_lines, format_lines, read_delimited, write_delimited
from keyloom.sources.entries import from_pairs, to_entries
from keyloom.sources.store import build, is_store, merge_stores, open_store
from keyloom.streaming.ingest import ingest, ingested
from pyspark.sql import functions as F


def pairs(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lines_are_cut_at_the_first_delimiter(spark):
    lines = ["a\tb\tc", "", "lonely", "\tv", 'q"\t"x']
    assert pairs(from_lines(spark, lines)) == sorted([("a", "b\tc"), ("lonely", ""), ("", "v"), ('q"', '"x')])
    assert pairs(from_lines(spark, ["a::b::c", "d:e"], "::")) == [("a", "b::c"), ("d:e", "")]
    with pytest.raises(Exception, match="no delimiter"):
        from_lines(spark, ["lonely"], strict=True).collect()
    with pytest.raises(ValueError):
        from_lines(spark, ["x"], "")


def test_base64_is_unpadded_and_on_one_line(spark):
    entries = from_lines(spark, ["aGVsbG8\tZ29vZGJ5ZQ=="], base64=True)
    assert [(bytes(r[0]), bytes(r[1])) for r in entries.select("key", "value").collect()] == [(b"hello", b"goodbye")]
    assert format_lines(entries, keys_only=True, base64=True).first()[0] == "aGVsbG8"
    long = from_pairs(spark, {"x" * 100: ""})
    assert "\n" not in format_lines(long, base64=True).first()[0]


def test_text_roundtrip(spark, tmp_path):
    write_delimited(from_pairs(spark, {"a": "1", "b": "2 3"}), str(tmp_path / "t"))
    assert pairs(read_delimited(spark, str(tmp_path / "t"))) == [("a", "1"), ("b", "2 3")]


@pytest.mark.parametrize("codec", sorted(CODECS))
def test_store_roundtrip(spark, tmp_path, codec):
    data = {f"k{i}": f"v{i}" for i in range(50)} | {"": "e", "e": ""}
    store = build(from_pairs(spark, data), str(tmp_path / codec), shards=4, codec=codec)
    assert dict(pairs(store.entries())) == data
    assert is_store(spark, store.path) and not is_store(spark, str(tmp_path / "absent"))
    assert store.get("k7") == "v7" and store.get("e") == "" and store.get("x") is None
    assert store.manifest().agg(F.sum("entries")).first()[0] == 52


def test_lookup_reads_one_shard_and_pushes_the_key(spark, tmp_path):
    store = build(from_pairs(spark, {f"k{i}": "v" for i in range(100)}), str(tmp_path / "s"), shards=8, splits=2)
    text = plan(store.lookup("k5"))
    assert "PartitionFilters: [isnotnull(shard" in text and "PushedFilters: [IsNotNull(key), EqualTo(key,k5)]" in text
    assert "value" not in plan(store.keys()).split("ReadSchema")[-1]
    asked = spark.createDataFrame([("k1",), ("k2",), ("zz",)], "key string")
    assert pairs(store.multi_get(asked)) == [("k1", "v"), ("k2", "v")]


def test_store_order_and_shards(spark, tmp_path):
    store = build(from_pairs(spark, {f"k{i}": "v" for i in range(200)}), str(tmp_path / "s"), shards=4, hash_name="md5_32")
    rows = store.rows().select("shard", hash_of(F.col("key"), "md5_32").alias("h"), F.input_file_name().alias("f")).collect()
    assert all(r["h"] >> 30 == r["shard"] for r in rows)
    for f in {r["f"] for r in rows}:
        hs = [r["h"] for r in rows if r["f"] == f]
        assert hs == sorted(hs)
    one = build(from_pairs(spark, {"a": "1"}), str(tmp_path / "one"), shards=1)
    assert one.get("a") == "1"
    for bad in (0, 3, 6):
        with pytest.raises(ValueError):
            shard_bits(bad)
    with pytest.raises(ValueError, match="unknown hash"):
        build(from_pairs(spark, {}), str(tmp_path / "x"), hash_name="md4")


def test_binary_empty_and_replaced_stores(spark, tmp_path):
    path = str(tmp_path / "s")
    build(from_pairs(spark, {b"\xff": b"\x00"}), path, shards=2)
    assert open_store(spark, path, cached=True).get(b"\xff") == b"\x00"
    empty = build(from_pairs(spark, {}), path, shards=2)
    assert empty.entries().count() == 0 and empty.get("a") is None and is_store(spark, path)
    with pytest.raises(OSError):
        open_store(spark, str(tmp_path / "nowhere"))


def test_merge_stores(spark, tmp_path):
    a = build(from_pairs(spark, {"a": "1", "b": "2"}), str(tmp_path / "a"), shards=2)
    b = build(from_pairs(spark, {"b": "5"}), str(tmp_path / "b"), shards=2)
    assert pairs(merge_stores([a, b], str(tmp_path / "c"), shards=2).entries()) == [("a", "1"), ("b", "5")]
    assert pairs(merge_stores([a, b], str(tmp_path / "d"), f="sum", shards=2).entries()) == [("a", "1"), ("b", "7")]
    # also into the place of one of them
    assert pairs(merge_stores([a, b], a.path, shards=2).entries()) == [("a", "1"), ("b", "5")]


def test_a_store_must_be_whole(spark, tmp_path):
    path = tmp_path / "s"
    store = build(from_pairs(spark, {f"k{i}": "v" for i in range(200)}), str(path), shards=4)
    part = next(Path(store.place).glob("entries/shard=1"))
    shutil.move(part, tmp_path / "away")
    assert not is_store(spark, str(path))
    with pytest.raises(OSError, match="lacks entries"):
        open_store(spark, str(path))
    shutil.move(tmp_path / "away", part)
    assert is_store(spark, str(path))
    # cut off within a file
    file = next(part.glob("*.parquet"))
    data = file.read_bytes()
    file.write_bytes(data[:-9])
    assert not is_store(spark, str(path))


def test_a_build_that_breaks_off_leaves_the_store(spark, tmp_path):
    path = str(tmp_path / "s")
    store = build(from_pairs(spark, {"a": "1"}), path, shards=2)
    with pytest.raises(Exception, match="null"):
        build(to_entries(spark.createDataFrame([("b", None)], "key string, value string"), "key", "value"), path, shards=2)
    # entries without a manifest, as a crash would leave them
    half = tmp_path / "s" / "v000000007" / "entries"
    half.mkdir(parents=True)
    (half / "x.parquet").write_bytes(b"")
    assert open_store(spark, path).get("a") == "1"
    newer = build(last_wins(store.entries(), from_pairs(spark, {"c": "3"})), path, shards=2, duplicates="keep")
    assert pairs(newer.entries()) == [("a", "1"), ("c", "3")] and [p.name for p in (tmp_path / "s").glob("v*")] == ["v000000008"]


def test_cached_stores_answer_from_memory(spark, tmp_path):
    path = str(tmp_path / "s")
    build(from_pairs(spark, {f"k{i}": "v" for i in range(20)}), path, shards=2)
    store = open_store(spark, path, cached=True)
    assert store.get("k3") == "v" and "InMemoryTableScan" in store.lookup("k3")._jdf.queryExecution().executedPlan().toString()
    SourceSet().add("s", store).close()
    assert "InMemoryTableScan" not in store.lookup("k3")._jdf.queryExecution().executedPlan().toString()


def test_sets_read_only_stores_that_may_hold_a_key(spark, tmp_path):
    data = [{f"k{i}": f"{n}" for i in range(n, 40, 4)} for n in range(4)] + [{"k1": "last"}]
    held = SourceSet()
    for n, pairs_ in enumerate(data):
        held = held.add(str(n), build(from_pairs(spark, pairs_), str(tmp_path / str(n)), shards=16, hash_name=["murmur3", "md5_32"][n % 2]))
    held = held.add("frame", from_pairs(spark, {"k2": "frame"}))
    read = 0
    for i in range(42):
        at = held.candidates(f"k{i}")
        read += len(at) - 1
        assert "frame" in at and all(str(n) in at for n, d in enumerate(data) if f"k{i}" in d)
    assert read < 42 * 3
    assert [held.get(k) for k in ("k0", "k1", "k2", "k3", "none")] == ["0", "last", "frame", "3", None]
    assert held.remove("4").get("k1") == "1" and SourceSet().add("4", held.sources[4][1]).lookup("k30") is None
    held.close()


def test_few_keys_cut_the_entries_down_first(spark, monkeypatch):
    rows = from_pairs(spark, {f"k{i}": f"v{i}" for i in range(30)}).select("key", "value")
    asked = spark.createDataFrame([("k1",), ("k1",), ("no",)], "key string")
    ways = {how: sorted(map(tuple, lookup.multi_get(rows, asked, how).collect()), key=str) for how in lookup.WAYS}
    assert ways == {"left": [("k1", "v1"), ("k1", "v1"), ("no", None)], "inner": [("k1", "v1")] * 2, "semi": [("k1",)] * 2, "anti": [("no",)]}
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", 1)
    assert {how: sorted(map(tuple, lookup.multi_get(rows, asked, how).collect()), key=str) for how in lookup.WAYS} == ways


def test_hashes_against_other_libraries(spark):
    keys = ["", "a", "abcd", "abcdefg", "schlüssel", "x" * 99]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r for r in df.select("key", *[f(F.col("key")).alias(n) for n, f in HASHES.items()]).collect()}

    def murmur3(data):
        """As Spark has it: whole words, then each byte left over, signed, like a word."""
        h, mask = 42, 0xFFFFFFFF
        cut = len(data) // 4 * 4
        for k in [int.from_bytes(data[i : i + 4], "little") for i in range(0, cut, 4)] + [b - 256 if b > 127 else b for b in data[cut:]]:
            k = k * 0xCC9E2D51 & mask
            k = (k << 15 | k >> 17) * 0x1B873593 & mask
            h ^= k
            h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        return h ^ h >> 16

    for k in keys:
        b = k.encode()
        wanted = {"crc32": zlib.crc32(b), "md5_32": int(hashlib.md5(b).hexdigest()[:8], 16), "xxhash32": xxhash.xxh64_intdigest(b, 42) >> 32, "murmur3": murmur3(b)}
        assert {n: got[k][n] for n in HASHES} == wanted


def test_validate_tells_totals_and_benchmark_reads_all_stores(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.tsv").write_text(f"{n}\t1\n")
        assert cli.main(["build", "--block-size", "4096", str(tmp_path / f"{n}.tsv"), str(tmp_path / n)], spark) == 0
    out = io.StringIO()
    assert cli.main(["validate", str(tmp_path / "a"), str(tmp_path / "b")], spark, out) == 0
    assert out.getvalue().splitlines()[-1].startswith("all 2: 2 entries, 20 bytes, nothing missing")
    assert open_store(spark, str(tmp_path / "a")).block_size == 4096
    out = io.StringIO()
    assert cli.main(["benchmark", "-n", "2", str(tmp_path / "a"), str(tmp_path / "b")], spark, out) == 0
    assert len(out.getvalue().splitlines()) == 8


def test_bucketed_merge_has_no_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        save_bucketed(from_pairs(spark, {f"k{i}": "old" for i in range(40)}), "old", 4)
        save_bucketed(from_pairs(spark, {f"k{i}": "new" for i in range(0, 40, 2)}), "new", 4, str(tmp_path / "new"))
        save_bucketed(from_pairs(spark, {f"k{i}": "newest" for i in range(0, 50, 10)}), "newest", 4)
        merged = merge_bucketed(spark, "old", "new")
        assert sum(r["value"] == "new" for r in merged.collect()) == 20
        assert "Exchange" not in plan(merged)
        merged = merge_bucketed(spark, "old", "new", "newest")
        assert Counter(r["value"] for r in merged.collect()) == {"old": 20, "new": 16, "newest": 5} and merged.count() == 41
        assert "Exchange" not in plan(merged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS old")
        spark.sql("DROP TABLE IF EXISTS new")
        spark.sql("DROP TABLE IF EXISTS newest")


def test_command_line(spark, tmp_path, capsys):
    def run(*args):
        out = io.StringIO()
        return cli.main([*args], spark, out), out.getvalue()

    one, two, three = (str(tmp_path / n) for n in "123")
    (tmp_path / "1.tsv").write_text("1\t2\n3\t4\n")
    (tmp_path / "2.tsv").write_text("3\t5\n")
    (tmp_path / "3.tsv").write_text("1\t42\n")
    assert run("build", str(tmp_path / "1.tsv"), one)[0] == 0 and run("build", str(tmp_path / "2.tsv"), two)[0] == 0
    assert sorted(run("keys", one, two)[1].split()) == ["1", "3"]
    assert run("get", "3", one, two) == (0, "5\n") and run("get", "3", two, one) == (0, "4\n")
    assert run("build", one, two, str(tmp_path / "3.tsv"), three)[0] == 0
    assert run("get", "1", three) == (0, "42\n") and run("get", "8", three)[0] == 1
    assert "nothing missing" in run("validate", three)[1]
    assert run("keys", str(tmp_path / "none"))[0] == 1
    assert sorted(run("decode", "-d", "=", three)[1].split()) == ["1=42", "3=5"]
    (tmp_path / "b.tsv").write_text("aGVsbG8=\tZ29vZGJ5ZQ==\n")
    assert run("build", "-b", str(tmp_path / "b.tsv"), str(tmp_path / "b"))[0] == 0
    assert run("keys", "-b", str(tmp_path / "b")) == (0, "aGVsbG8\n") and run("keys", str(tmp_path / "b")) == (0, "hello\n")
    assert run("get", "hello", str(tmp_path / "b")) == (0, "goodbye\n")
    assert run("merge", one, two, str(tmp_path / "m"))[0] == 0 and run("get", "3", str(tmp_path / "m")) == (0, "5\n")


@pytest.fixture
def advisory(spark):
    """Settings under which adaptive execution cuts a test's few rows."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hash_text(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


def most_in_a_file(store):
    return store.rows().groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_a_share_of_a_build_keeps_its_size(spark, tmp_path, advisory, n):
    rows = spark.range(0, n, 1, 16).select(F.col("id").cast("string").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"), F.lit(0).alias("src"), F.lit(0).cast("long").alias("ord"))
    for name, options in (("last", {}), ("keep", {"duplicates": "keep"}), ("splits", {"splits": 4})):
        store = build(rows, str(tmp_path / name), shards=2, **options)
        assert most_in_a_file(store) <= 6000
        assert store.entries().exceptAll(rows.select("key", "value")).isEmpty() and store.entries().count() == n
        assert store.manifest().agg(F.sum("entries"), F.count("*")).first()[:] == (n, 2)
        assert store.get("77") == hash_text(77) and store.get("x") is None
        breaks = order_breaks(store.rows().withColumn("h", hash_of(F.col("key"), store.hash)), "shard").collect()
        assert sorted((r["shard"], r["breaks"]) for r in breaks) == [(0, 0), (1, 0)]


def test_shares_of_a_streaming_ingest_keep_their_size(spark, tmp_path, advisory):
    incoming, stores, marks = (str(tmp_path / n) for n in ("in", "stores", "marks"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("".join(f"{i}\t{hash_text(i)}\n" for i in range(80_000)) + "7\tlast\n")
    ingest(spark, incoming, stores, marks, shards=2).awaitTermination()
    found = ingested(spark, stores)
    [(_, store)] = found.sources
    assert most_in_a_file(store) <= 6000
    assert found.entries().count() == 80_000 and found.get("7") == "last" and found.get("9") == hash_text(9)


def test_streaming_ingest(spark, tmp_path):
    incoming, stores, marks = (str(tmp_path / n) for n in ("in", "stores", "marks"))
    (tmp_path / "in").mkdir()
    (tmp_path / "stores").mkdir()
    for name, text in (("a.tsv", "k\told\nj\t1\n"), ("b.tsv", "k\tnew\n")):
        (tmp_path / "in" / name).write_text(text)
        ingest(spark, incoming, stores, marks, shards=2).awaitTermination()
    assert pairs(ingested(spark, stores).entries()) == [("j", "1"), ("k", "new")]


def test_python_fold_of_text_numbers(spark):
    assert pairs(fold(from_pairs(spark, [("a", "1"), ("a", "2")]), "sum")) == [("a", "3")]
