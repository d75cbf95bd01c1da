import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import merge
from keyloom.sources.entries import binary_entries, from_pairs, same_entries, to_entries


def as_dict(df):
    rows = df.collect()
    assert len({bytes(r["key"]) if isinstance(r["key"], bytearray) else r["key"] for r in rows}) == len(rows)
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    return {plain(r["key"]): plain(r["value"]) for r in rows}


def random_map(rng, numbers=False):
    text = lambda: "".join(rng.choice("abcxyz 09") for _ in range(rng.randrange(4)))
    return {text(): str(rng.randrange(100)) if numbers else text() for _ in range(rng.randrange(30))}


@pytest.mark.parametrize("seed", range(3))
def test_last_wins_equals_dict_update(spark, seed):
    rng = random.Random(seed)
    maps = [random_map(rng) for _ in range(3)]
    assert as_dict(merge.last_wins(*[from_pairs(spark, m) for m in maps])) == {**maps[0], **maps[1], **maps[2]}


def test_fold_sums_like_a_model(spark):
    rng = random.Random(5)
    a, b = random_map(rng, True), random_map(rng, True)
    model = dict(a)
    for k, v in b.items():
        model[k] = str(int(model.get(k, 0)) + int(v))
    stacked = merge.stack(from_pairs(spark, a), from_pairs(spark, b))
    assert as_dict(merge.fold(stacked, "sum")) == model
    assert as_dict(merge.fold_python(stacked, lambda x, y: str(int(x) + int(y)))) == model


def test_fold_passes_the_newer_value_first(spark):
    stacked = merge.stack(from_pairs(spark, [("k", "a"), ("k", "b")]), from_pairs(spark, [("k", "c")]))
    for f in (merge.fold(stacked, lambda x, y: F.concat(x, y)), merge.fold_python(stacked, lambda x, y: x + y), merge.fold(stacked, lambda x, y: F.concat(x, y), associative=True)):
        assert as_dict(f) == {"k": "cba"}


def test_associative_fold_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merge, "CHUNK", 3)
    entries = from_pairs(spark, [("k", chr(97 + i)) for i in range(20)])
    assert as_dict(merge.fold(entries, lambda x, y: F.concat(x, y), associative=True)) == {"k": "tsrqponmlkjihgfedcba"}


def test_duplicates_within_a_source(spark):
    entries = from_pairs(spark, [("k", "1"), ("j", "2"), ("k", "3")])
    assert as_dict(merge.dedupe(entries)) == {"k": "3", "j": "2"}
    assert merge.dedupe(entries, "keep").count() == 3
    with pytest.raises(Exception, match="repeated key"):
        merge.dedupe(entries, "error").collect()
    with pytest.raises(ValueError):
        merge.dedupe(entries, "first")


def test_sets_of_sources(spark):
    one, two, three = (from_pairs(spark, m) for m in ({"1": "2", "3": "4"}, {"3": "5"}, {"1": "42"}))
    s = merge.SourceSet().add("one", one).add("two", two)
    assert s.get("3") == "5" and s.get("9") is None
    assert merge.SourceSet().add("two", two).add("one", one).get("3") == "4"
    full = s.add("three", three)
    assert as_dict(full.entries()) == {"1": "42", "3": "5"}
    assert full.remove("two").get("3") == "4" and full.next_priority == 3
    assert full.add("one", one).names == ("two", "three", "one")
    assert s.names == ("one", "two")
    full.close()
    with pytest.raises(ValueError):
        merge.SourceSet().entries()


def test_edge_keys_and_values(spark):
    pairs = [(b"", b"empty key"), (b"k", b""), (b"\xff\x00", b"\x80"), (b"a", b"\xc3")]
    assert as_dict(merge.last_wins(from_pairs(spark, pairs))) == dict(pairs)
    order = [bytes(r[0]) for r in from_pairs(spark, pairs).orderBy("key").select("key").collect()]
    assert order == [b"", b"a", b"k", b"\xff\x00"]
    assert merge.last_wins(from_pairs(spark, {})).count() == 0


def test_null_and_wrong_types_are_refused(spark):
    df = spark.createDataFrame([("a", None)], "k string, v string")
    with pytest.raises(Exception, match="value is null"):
        to_entries(df, "k", "v").collect()
    with pytest.raises(TypeError):
        binary_entries(spark.createDataFrame([("a", "b")], "key string, value string"))


def test_same_entries(spark):
    a, b = from_pairs(spark, [("a", "1"), ("a", "1")]), from_pairs(spark, [("a", "1")])
    assert same_entries(a, a) and not same_entries(a, b)
