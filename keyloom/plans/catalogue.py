"""The engine's queries over the driver's tables, with equivalent SQL.

Views: `base` is orders by key (order priority), `delta` all line items by order, newer than base, where later lines are later
entries, `late` all customers by key, newer than delta; `ev` is events by user, later events being later entries. Stores of them lie in the folder
that the session shares.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import CHECKSUMS, HASHES, bucket_of, hash_of, shard_of
from ..functions.text import decode_base64, encode_base64, entry_bytes, to_text
from ..operators import blocks, lookup, merge, stats
from ..operators.sharded import assign_paths, merge_bucketed, of_shard, save_bucketed
from ..session import shared_folder
from ..sources.delimited import format_lines, from_lines, parse_lines, read_delimited, write_delimited
from ..sources.entries import binary_entries, same_entries, to_entries
from ..sources.store import Store, build, merge_stores, open_store
from ..streaming.ingest import ingest, ingested

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MD5 = "('0x' || substr(md5(key), 1, 8))::BIGINT"
VIEWS = f"""
base AS (SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS value, 0 AS src, 0::BIGINT AS ord FROM orders),
delta AS (SELECT l_orderkey::VARCHAR AS key, l_returnflag || l_linestatus || l_partkey::VARCHAR AS value, 1 AS src, l_linenumber::BIGINT AS ord FROM lineitem),
late AS (SELECT c_custkey::VARCHAR AS key, 'c' || c_mktsegment AS value, 2 AS src, 0::BIGINT AS ord FROM customer),
three AS (FROM base UNION ALL FROM delta UNION ALL FROM late),
ev AS (SELECT user_id::VARCHAR AS key, event_type AS value, event_id AS ord FROM events),
hashed AS (SELECT key, value, {MD5} AS h, ({MD5} >> 28)::INT AS shard FROM base)
"""


#: The value of the largest source, of the latest entry in it.
LAST = "arg_max(value, struct_pack(s := src, o := ord, v := value))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {VIEWS} {sql}"
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(spark: SparkSession, sf: str) -> DataFrame:
    return to_entries(_table(spark, sf, "orders"), F.col("o_orderkey").cast("string"), "o_orderpriority")


def delta(spark: SparkSession, sf: str) -> DataFrame:
    value = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    return to_entries(_table(spark, sf, "lineitem"), F.col("l_orderkey").cast("string"), value, "l_linenumber")


def late(spark: SparkSession, sf: str) -> DataFrame:
    return to_entries(_table(spark, sf, "customer"), F.col("c_custkey").cast("string"), F.concat(F.lit("c"), F.col("c_mktsegment")))


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return to_entries(_table(spark, sf, "events"), F.col("user_id").cast("string"), "event_type", "event_id")


def _cut() -> Column:
    """Leading bits of the hash, which cut each of 16 shards into 64 pieces."""
    return F.shiftrightunsigned("h", 22)


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    rows = base(spark, sf).withColumn("h", hash_of(F.col("key"), "md5_32"))
    return rows.withColumn("shard", shard_of(F.col("h"), 16)).withColumn("size", entry_bytes(F.col("key"), F.col("value")))


@query(f"SELECT key, {LAST} AS value FROM three WHERE src < 2 GROUP BY key")
def merge_last_wins(spark, sf):
    return merge.last_wins(base(spark, sf), delta(spark, sf))


@query(f"SELECT key, {LAST} AS value FROM three GROUP BY key")
def set_scan(spark, sf):
    return _set(spark, sf).entries()


def _set(spark, sf) -> merge.SourceSet:
    return merge.SourceSet().add("base", base(spark, sf)).add("delta", delta(spark, sf)).add("late", late(spark, sf))


@query(f"SELECT key, {LAST} AS value FROM three WHERE src <> 1 GROUP BY key")
def set_remove_source(spark, sf):
    return _set(spark, sf).remove("delta").entries()


@query("SELECT key, arg_max(value, struct_pack(s := CASE src WHEN 0 THEN 9 ELSE src END, o := ord, v := value)) AS value FROM three GROUP BY key")
def set_add_again(spark, sf):
    return _set(spark, sf).add("base", base(spark, sf)).entries()


@query("SELECT max(src) + 1 AS next_priority FROM three")
def next_priority(spark, sf):
    return _set(spark, sf).stacked().agg((F.max("src") + 1).alias("next_priority"))


@query("SELECT key, arg_max(value, ord) AS value FROM ev GROUP BY key")
def dedupe_last(spark, sf):
    return merge.dedupe(ev(spark, sf))


@query("SELECT key, value FROM ev")
def dedupe_keep(spark, sf):
    return merge.dedupe(ev(spark, sf), "keep")


@query("SELECT key, string_agg(value, ',' ORDER BY ord DESC) AS value FROM ev GROUP BY key")
def fold_newest_first(spark, sf):
    return merge.fold(ev(spark, sf), lambda a, b: F.concat(a, F.lit(","), b))


@query("SELECT key, string_agg(value, ',' ORDER BY ord DESC) AS value FROM ev GROUP BY key")
def fold_in_runs(spark, sf):
    return merge.fold(ev(spark, sf), lambda a, b: F.concat(a, F.lit(","), b), associative=True)


@query("SELECT key, string_agg(value, ',' ORDER BY ord DESC) AS value FROM ev GROUP BY key")
def fold_python(spark, sf):
    return merge.fold_python(ev(spark, sf), lambda a, b: f"{a},{b}")


@query("SELECT user_id::VARCHAR AS key, sum(floor(value)::BIGINT)::BIGINT::VARCHAR AS value FROM events GROUP BY user_id")
def fold_sum(spark, sf):
    numbers = to_entries(_table(spark, sf, "events"), F.col("user_id").cast("string"), F.floor("value").cast("string"), "event_id")
    return merge.fold(numbers, "sum")


@query("SELECT key, min(value) AS value FROM ev GROUP BY key")
def fold_min(spark, sf):
    return merge.fold(ev(spark, sf), "min")


@query("SELECT key, max(value) AS value FROM ev GROUP BY key")
def fold_max(spark, sf):
    return merge.fold(ev(spark, sf), "max")


@query("SELECT key, count(*)::VARCHAR AS value FROM ev GROUP BY key")
def fold_count(spark, sf):
    return merge.fold(ev(spark, sf), "count")


@query("SELECT key, string_agg(value, '|' ORDER BY src DESC, ord DESC, value DESC) AS value FROM three GROUP BY key")
def merge_fold_sources(spark, sf):
    return merge.fold(_set(spark, sf).stacked(), lambda a, b: F.concat(a, F.lit("|"), b))


@query("SELECT value FROM base WHERE key = '7'")
def point_get(spark, sf):
    return lookup.point_get(base(spark, sf), "7").select("value")


@query(f"SELECT {LAST} AS value FROM three WHERE key = '15'")
def point_get_set(spark, sf):
    return _set(spark, sf).lookup("15")


def _asked(spark, sf) -> DataFrame:
    return _table(spark, sf, "customer").select((F.col("c_custkey") * 17).cast("string").alias("key"))


ASKED = "(SELECT (c_custkey * 17)::VARCHAR AS key FROM customer) a"


@query(f"SELECT a.key, base.value FROM {ASKED} LEFT JOIN base ON base.key = a.key")
def multi_get_left(spark, sf):
    return lookup.multi_get(base(spark, sf), _asked(spark, sf))


@query(f"SELECT a.key, base.value FROM {ASKED} JOIN base ON base.key = a.key")
def multi_get_inner(spark, sf):
    return lookup.multi_get(base(spark, sf), _asked(spark, sf), "inner")


@query(f"SELECT a.key FROM {ASKED} WHERE EXISTS (SELECT 1 FROM base WHERE base.key = a.key)")
def keys_semi(spark, sf):
    return lookup.multi_get(base(spark, sf), _asked(spark, sf), "semi")


@query(f"SELECT a.key FROM {ASKED} WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.key = a.key)")
def keys_anti(spark, sf):
    return lookup.multi_get(base(spark, sf), _asked(spark, sf), "anti")


@query("SELECT DISTINCT key FROM ev")
def keys_only(spark, sf):
    return ev(spark, sf).select("key").distinct()


@query("SELECT value FROM base")
def values_only(spark, sf):
    return base(spark, sf).select("value")


@query(f"SELECT key FROM base ORDER BY {MD5}, key LIMIT 100")
def sample_keys(spark, sf):
    return lookup.sample_keys(base(spark, sf), 100)


def _lines(spark, sf) -> DataFrame:
    return _table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


LINES = "(SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) > 0"


@query(f"SELECT CASE WHEN instr(l, ' ') > 0 THEN substr(l, 1, instr(l, ' ') - 1) ELSE l END AS key, CASE WHEN instr(l, ' ') > 0 THEN substr(l, instr(l, ' ') + 1) ELSE '' END AS value FROM {LINES}")
def parse_delimited(spark, sf):
    return parse_lines(_lines(spark, sf), " ").select("key", "value")


@query(f"SELECT CASE WHEN instr(l, ', ') > 0 THEN substr(l, 1, instr(l, ', ') - 1) ELSE l END AS key, CASE WHEN instr(l, ', ') > 0 THEN substr(l, instr(l, ', ') + 2) ELSE '' END AS value FROM {LINES}")
def parse_long_delimiter(spark, sf):
    return parse_lines(_lines(spark, sf), ", ").select("key", "value")


@query("SELECT key || chr(9) || value AS value FROM base")
def decode_text(spark, sf):
    return format_lines(base(spark, sf))


@query("SELECT rtrim(to_base64(encode(key)), '=') || ':' || rtrim(to_base64(encode(value)), '=') AS value FROM base")
def decode_base64_text(spark, sf):
    return format_lines(base(spark, sf), ":", base64=True)


@query("SELECT doc_id, rtrim(to_base64(encode(text)), '=') AS encoded, text AS decoded FROM documents")
def base64_roundtrip(spark, sf):
    coded = _table(spark, sf, "documents").select("doc_id", encode_base64(F.col("text")).alias("encoded"))
    return coded.withColumn("decoded", to_text(decode_base64(F.col("encoded"))))


@query(f"SELECT ({MD5} >> 26)::INT AS shard, count(*) AS entries FROM base GROUP BY 1")
def shard_counts(spark, sf):
    h = hash_of(F.col("key"), "md5_32")
    return base(spark, sf).groupBy(shard_of(h, 64).alias("shard")).agg(F.count("*").alias("entries"))


@query(f"SELECT key, value FROM base WHERE ({MD5} >> 29) = 5")
def shard_filter(spark, sf):
    return of_shard(base(spark, sf), 5, 8, "md5_32").select("key", "value")


@query(f"SELECT ({MD5} >> 22)::INT AS bucket, count(*) AS entries FROM base GROUP BY 1")
def bucket_counts(spark, sf):
    return base(spark, sf).groupBy(bucket_of(hash_of(F.col("key"), "md5_32")).alias("bucket")).agg(F.count("*").alias("entries"))


MASKS = "masks AS (SELECT shard, bit_and(h) AS shared_hash, (~xor(bit_and(h), bit_or(h))) & 4294967295 AS hash_mask FROM hashed GROUP BY shard)"


@query(f", {MASKS} SELECT shard, shared_hash, hash_mask FROM masks")
def hash_mask_by_shard(spark, sf):
    return stats.hash_mask(hashed(spark, sf), "shard")


@query(f", {MASKS} SELECT shard AS source, i::INT AS bucket FROM masks, range(1024) r(i) WHERE (i & (hash_mask >> 22)) = ((shared_hash >> 22) & (hash_mask >> 22))")
def bucket_membership(spark, sf):
    return lookup.bucket_members(stats.hash_mask(hashed(spark, sf), "shard").withColumnRenamed("shard", "source"))


@query(f", {MASKS} SELECT shard FROM masks WHERE (hash_mask & 123456789) = (shared_hash & hash_mask)")
def source_prefilter(spark, sf):
    return lookup.may_hold(stats.hash_mask(hashed(spark, sf), "shard"), F.lit(123456789)).select("shard")


@query("SELECT shard, count(*) AS entries, count(DISTINCT key) AS keys, sum(strlen(key) + strlen(value) + 8)::BIGINT AS bytes FROM hashed GROUP BY shard")
def validate_counts(spark, sf):
    return stats.counts(hashed(spark, sf), "shard")


@query("SELECT h, count(*) AS n FROM (SELECT h // 65536 AS h FROM hashed) GROUP BY h")
def group_by_hash(spark, sf):
    return hashed(spark, sf).groupBy(F.shiftrightunsigned("h", 16).alias("h")).agg(F.count("*").alias("n"))


@query("SELECT shard, key, coalesce(sum(strlen(key) + strlen(value) + 8) OVER (PARTITION BY shard ORDER BY h, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM hashed")
def running_offset(spark, sf):
    return blocks.running_offsets(hashed(spark, sf), "shard", ["h", "key"], cut=_cut()).select("shard", "key", "offset")


@query(", o AS (SELECT shard, h, coalesce(sum(strlen(key) + strlen(value) + 8) OVER (PARTITION BY shard ORDER BY h, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM hashed) SELECT shard, h, min(off) AS first_offset FROM o GROUP BY shard, h")
def first_offset_of_hash(spark, sf):
    rows = blocks.running_offsets(hashed(spark, sf), "shard", ["h", "key"], cut=_cut())
    return rows.groupBy("shard", "h").agg(F.min("offset").alias("first_offset"))


@query("SELECT shard, key, dense_rank() OVER (PARTITION BY shard ORDER BY h) - 1 AS ordinal FROM hashed")
def hash_ordinal(spark, sf):
    return blocks.hash_ordinals(hashed(spark, sf), "shard", _cut()).select("shard", "key", "ordinal")


@query("SELECT shard, count(*) AS entries, 0::BIGINT AS breaks FROM hashed GROUP BY shard")
def key_order_check(spark, sf):
    """In the order in which a store's files hold their entries, none is less than the one before."""
    rows = _store(spark, "order", base(spark, sf)).rows()
    return blocks.order_breaks(rows.withColumn("h", hash_of(F.col("key"), "md5_32")), "shard")


@query("SELECT count(*) AS entries, count(*) FILTER (h < last_h)::BIGINT AS breaks FROM (SELECT h, lag(h) OVER (ORDER BY key::BIGINT) AS last_h FROM hashed)")
def key_order_of_a_table(spark, sf):
    """The orders as they are stored, by number, are in no order of hashes."""
    rows = _table(spark, sf, "orders").withColumn("key", F.col("o_orderkey").cast("string"))
    return blocks.order_breaks(rows.withColumn("h", hash_of(F.col("key"), "md5_32")))


PACKED = f"""
p AS (SELECT ({MD5} >> 30)::INT AS shard, {MD5} AS h, count(*) AS n, sum(strlen(key) + strlen(value) + 8)::BIGINT AS size FROM base GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY h) AS i FROM p),
w AS (
  SELECT shard, i, n, 0::BIGINT AS block, size AS cur, 1 AS c FROM g WHERE i = 1
  UNION ALL
  SELECT g.shard, g.i, g.n, CASE WHEN w.c >= 255 OR w.cur >= 4096 THEN w.block + 1 ELSE w.block END,
    CASE WHEN w.c >= 255 OR w.cur >= 4096 THEN g.size ELSE w.cur + g.size END, CASE WHEN w.c >= 255 OR w.cur >= 4096 THEN 1 ELSE w.c + 1 END
  FROM w JOIN g ON g.shard = w.shard AND g.i = w.i + 1)
"""


@query()
def pack_blocks(spark, sf):
    return blocks.number_blocks(base(spark, sf), 4, 4096, "md5_32").groupBy("shard", "block").agg(F.count("*").alias("n"))


SQL["pack_blocks"] = f"WITH RECURSIVE {VIEWS}, {PACKED} SELECT shard, block, sum(n)::BIGINT AS n FROM w GROUP BY shard, block"


@query("SELECT key, value FROM base")
def block_roundtrip(spark, sf):
    back = blocks.decode_blocks(blocks.encode_blocks(base(spark, sf), 4))
    return back.select(to_text(F.col("key")).alias("key"), to_text(F.col("value")).alias("value"))


@query("SELECT count(*) AS entries, count(*) AS sound_entries, 0::BIGINT AS bad_blocks, 0::BIGINT AS missing FROM base")
def validate_blocks(spark, sf):
    return blocks.validate(blocks.encode_blocks(base(spark, sf), 4)).select("entries", "sound_entries", "bad_blocks", "missing")


@query()
def block_offsets(spark, sf):
    """Where each encoded block starts in its shard's file: 8 bytes of checksum and length before each payload."""
    sized = blocks.encode_blocks(base(spark, sf), 4, codec="none", hash_name="md5_32").withColumn("size", F.octet_length("payload").cast("long") + 8)
    return blocks.running_offsets(sized, "shard", ["block"]).select("shard", "block", "n", "size", "offset")


SQL["block_offsets"] = f"""
WITH RECURSIVE {VIEWS}, {PACKED},
b AS (SELECT shard, block, sum(g.n)::BIGINT AS n, (9 + 4 * count(*) + sum(g.size))::BIGINT AS size FROM w JOIN g USING (shard, i) GROUP BY shard, block)
SELECT *, coalesce(sum(size) OVER (PARTITION BY shard ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM b
"""


@query()
def one_block(spark, sf):
    """The entries of the second block of the last shard."""
    found = blocks.read_block(blocks.encode_blocks(base(spark, sf), 4, hash_name="md5_32"), 3, 1)
    return found.select(to_text(F.col("key")).alias("key"), to_text(F.col("value")).alias("value"))


SQL["one_block"] = f"""
WITH RECURSIVE {VIEWS}, {PACKED}
SELECT key, value FROM w JOIN g USING (shard, i) JOIN hashed ON hashed.h = g.h WHERE w.shard = 3 AND block = 1
"""


QS = "[0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]"


@query(f"SELECT q::DOUBLE AS q, round(v, 6) AS value FROM (SELECT unnest({QS}) AS q, unnest(quantile_cont(value, {QS})) AS v FROM events)")
def latency_quantiles(spark, sf):
    return stats.quantiles(_table(spark, sf, "events"), "value").select("q", F.round("value", 6).alias("value"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY event_type")
def welford_stats(spark, sf):
    rows = stats.moments(_table(spark, sf, "events"), "value", "event_type")
    return rows.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT event_type, floor(avg(value) + sqrt(coalesce(var_samp(value), 4096)) / 4)::BIGINT AS read_size FROM events GROUP BY event_type")
def read_size_estimate(spark, sf):
    rows = stats.moments(_table(spark, sf, "events"), "value", "event_type")
    return rows.select("event_type", stats.read_size(F.col("mean"), F.col("variance"), F.col("n")).alias("read_size"))


@query("SELECT round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM events")
def throughput(spark, sf):
    return stats.throughput(_table(spark, sf, "events"), "ts").select(F.round("per_second", 9).alias("per_second"))


@query("SELECT source, path, floor((row_number() OVER (PARTITION BY source ORDER BY path) - 1) * 8 / count(*) OVER (PARTITION BY source))::INT AS shard FROM (SELECT p_brand AS source, p_partkey::VARCHAR AS path FROM part)")
def shard_paths(spark, sf):
    files = _table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("path"))
    return assign_paths(files, 8)


#: CRC-32 of a text of one-byte characters, by the table of its bytes' remainders.
CRC_TABLE = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]


def _crc_sql(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::BIGINT)"
    step = f"lambda c, x: xor({CRC_TABLE}[1 + (xor(c, x) & 255)], c >> 8)"
    return f"xor(list_reduce({codes}, {step}, 4294967295::BIGINT), 4294967295)"


@query(f"SELECT key, {_crc_sql('value')} AS checksum FROM base")
def checksum_crc32(spark, sf):
    return base(spark, sf).select("key", CHECKSUMS["crc32"](F.col("value")).alias("checksum"))


@query(f"SELECT key, {_crc_sql('key')} AS crc32, {MD5} AS md5_32 FROM base")
def hash_registry(spark, sf):
    return base(spark, sf).select("key", *[HASHES[name](F.col("key")).alias(name) for name in ("crc32", "md5_32")])


@query()
def hash_registry_of_spark(spark, sf):
    """The two hashes that SQL elsewhere lacks."""
    return base(spark, sf).select("key", *[HASHES[name](F.col("key")).alias(name) for name in ("murmur3", "xxhash32")])


# -- stores, files and streams


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stores/{name}"


def _store(spark: SparkSession, name: str, entries: DataFrame, **options) -> Store:
    return build(entries, _place(spark, name), **{"shards": 16, "hash_name": "md5_32", **options})


def _stores(spark: SparkSession, sf: str, name: str) -> list[Store]:
    return [_store(spark, f"{name}-{view.__name__}", view(spark, sf)) for view in (base, delta, late)]


@query("SELECT key, value FROM base")
def store_build_scan(spark, sf):
    _store(spark, "scan", base(spark, sf), codec="zstd", block_size=1 << 16)
    return open_store(spark, _place(spark, "scan")).entries()


@query(f"SELECT key, value, ({MD5} >> 30)::INT AS shard FROM base")
def store_rows(spark, sf):
    return _store(spark, "rows", base(spark, sf), shards=4, splits=4).rows()


@query("SELECT key, value FROM base")
def store_cached(spark, sf):
    _store(spark, "cached", base(spark, sf))
    return open_store(spark, _place(spark, "cached"), cached=True).entries()


@query("SELECT key FROM base")
def store_keys(spark, sf):
    return _store(spark, "keys", base(spark, sf)).keys()


@query("SELECT value FROM base WHERE key = '7'")
def store_get(spark, sf):
    return _store(spark, "get", base(spark, sf)).lookup("7")


@query(f"SELECT a.key, base.value FROM {ASKED} JOIN base ON base.key = a.key")
def store_multi_get(spark, sf):
    return _store(spark, "multi-get", base(spark, sf)).multi_get(_asked(spark, sf))


@query("SELECT shard, count(*) AS entries, sum(strlen(key) + strlen(value) + 8)::BIGINT AS bytes, bit_and(h) AS shared_hash, (~xor(bit_and(h), bit_or(h))) & 4294967295 AS hash_mask FROM hashed GROUP BY shard")
def store_manifest(spark, sf):
    return _store(spark, "manifest", base(spark, sf)).manifest().select("shard", "entries", "bytes", "shared_hash", "hash_mask")


@query("SELECT DISTINCT 'md5_32' AS hash, 'gzip' AS codec, 65536 AS block_size, 16 AS shards, 'string' AS key_type, 'string' AS value_type FROM base")
def store_header(spark, sf):
    made = _store(spark, "header", base(spark, sf), codec="gzip", block_size=1 << 16).manifest()
    return made.select("hash", "codec", "block_size", "shards", "key_type", "value_type").distinct()


@query("SELECT count(*) AS told, count(*) AS seen, 0::BIGINT AS missing FROM (SELECT DISTINCT key FROM delta)")
def store_validate(spark, sf):
    store = _store(spark, "validate", delta(spark, sf))
    told = store.manifest().agg(F.sum("entries").alias("told"))
    return told.crossJoin(stats.counts(store.entries("skip")).select(F.col("entries").alias("seen"))).withColumn("missing", F.col("told") - F.col("seen"))


@query(f"SELECT key, {LAST} AS value FROM three GROUP BY key")
def store_merge(spark, sf):
    return merge_stores(_stores(spark, sf, "merge"), _place(spark, "merged"), shards=16, hash_name="md5_32").entries()


@query(f", one AS (SELECT key, src, {LAST} AS value FROM three GROUP BY key, src) SELECT key, string_agg(value, '|' ORDER BY src DESC) AS value FROM one GROUP BY key")
def store_merge_fold(spark, sf):
    return merge_stores(_stores(spark, sf, "fold"), _place(spark, "folded"), lambda a, b: F.concat(a, F.lit("|"), b), shards=16).entries()


@query(f"SELECT key, {LAST} AS value FROM three GROUP BY key")
def store_replaced(spark, sf):
    """A store that is built of its own entries and newer ones, twice, where it lies."""
    store = _store(spark, "replaced", base(spark, sf))
    for newer in (delta, late):
        store = _store(spark, "replaced", merge.last_wins(store.entries(), newer(spark, sf)), duplicates="keep")
    return store.entries()


def _store_set(spark, sf, name) -> merge.SourceSet:
    return reduce(lambda held, store: held.add(store.path.rpartition("-")[2], store), _stores(spark, sf, name), merge.SourceSet())


@query(f"SELECT {LAST} AS value FROM three WHERE key = '15'")
def store_set_get(spark, sf):
    return _store_set(spark, sf, "set").lookup("15")


@query(f", hs AS (SELECT DISTINCT src, {MD5} AS h FROM three), x AS (SELECT ('0x' || substr(md5('15'), 1, 8))::BIGINT AS x), ms AS (SELECT src, bit_and(h) AS s, (~xor(bit_and(h), bit_or(h))) & 4294967295 AS m FROM hs, x WHERE h >> 28 = x >> 28 GROUP BY src) SELECT CASE src WHEN 0 THEN 'base' WHEN 1 THEN 'delta' ELSE 'late' END AS source FROM ms, x WHERE x & m = s & m")
def store_candidates(spark, sf):
    """The stores of a set that are read for a key."""
    return spark.createDataFrame([(name,) for name in _store_set(spark, sf, "candidates").candidates("15")], "source string")


@query(f"SELECT key, {LAST} AS value FROM three GROUP BY key")
def store_set_scan(spark, sf):
    return _store_set(spark, sf, "set-scan").entries()


@query("SELECT hex(encode(key)) AS key, hex(encode(value)) AS value FROM base")
def store_binary(spark, sf):
    rows = base(spark, sf).select(F.col("key").cast("binary"), F.col("value").cast("binary"))
    return _store(spark, "binary", binary_entries(rows)).entries().select(F.hex("key").alias("key"), F.hex("value").alias("value"))


@query("SELECT true AS same, false AS other")
def store_same_entries(spark, sf):
    store = _store(spark, "same", base(spark, sf))
    return spark.createDataFrame([(same_entries(store.entries(), base(spark, sf)), same_entries(store.entries(), late(spark, sf)))], "same boolean, other boolean")


@query(f"SELECT key, {LAST} AS value FROM three GROUP BY key")
def merge_buckets(spark, sf):
    for view in (base, delta, late):
        save_bucketed(merge.dedupe(view(spark, sf)), f"keyloom_{view.__name__}", 8, _place(spark, f"buckets-{view.__name__}"))
    return merge_bucketed(spark, "keyloom_base", "keyloom_delta", "keyloom_late")


@query("SELECT key, value FROM base")
def text_files_roundtrip(spark, sf):
    write_delimited(base(spark, sf), _place(spark, "text"), "::", base64=True)
    back = read_delimited(spark, _place(spark, "text"), "::", base64=True)
    return back.select(to_text(F.col("key")).alias("key"), to_text(F.col("value")).alias("value"))


@query("SELECT key, value FROM base")
def parse_strict(spark, sf):
    return parse_lines(format_lines(base(spark, sf)), strict=True).select("key", "value")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation")
def parse_lines_of_the_driver(spark, sf):
    lines = [f"{r[0]}\t{r[1]}\n" for r in _table(spark, sf, "nation").select("n_nationkey", "n_name").collect()]
    return from_lines(spark, lines).select("key", "value")


@query(f"SELECT key, {LAST} AS value FROM three WHERE src <> 1 GROUP BY key")
def stream_ingest(spark, sf):
    """Text that arrives in two goes; what comes later wins."""
    stores = _place(spark, f"stream-{uuid4().hex}")
    for view in (base, late):
        format_lines(view(spark, sf)).write.mode("append").text(f"{stores}-in")
        ingest(spark, f"{stores}-in", stores, f"{stores}-marks", shards=4).awaitTermination()
    return ingested(spark, stores).entries().select("key", "value")


@query("SELECT key, upper(value) AS value FROM base WHERE length(value) > 6")
def entries_transformed(spark, sf):
    """Filters and maps of entries, as functions of DataFrames."""
    return base(spark, sf).transform(lambda df: df.where(F.length("value") > 6)).transform(lambda df: df.select("key", F.upper("value").alias("value")))


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
