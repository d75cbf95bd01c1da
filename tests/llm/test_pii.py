"""Surrogates against a plain version, over whole lists and between texts, and personal data that they once missed."""

import random
import re

import pytest

from keyloom.llm import surrogates


@pytest.mark.parametrize("text", ["password: correcthorse", "My Token:  'batterystaple' is that", "api_key:abcdefgh"])
def test_secrets_behind_a_colon_need_no_digits(text):
    value = text.split(":")[1].strip().split(" is")[0].strip("'")
    new, found = surrogates.rewrite(text, surrogates.Surrogates(b"k"))
    assert [k for _, _, k in found] == ["secret"] and value not in new and len(new) == len(text)


def test_a_text_with_most_of_a_list_has_no_collision():
    names = surrogates.KNOWN_NAMES["female"][:30]
    text = " ".join(f"{n} Bauer met {n}." for n in names) + " Mrs Zoe and Mrs Li spoke."
    new, found = surrogates.rewrite(text, surrogates.Surrogates(b"k"))
    old = {text[a:b] for a, b, _ in found}
    swapped = new.replace(".", "").split()
    bare = {n: swapped[4 * i + 3] for i, n in enumerate(names)}
    assert old >= set(names) | {"Li"} and not set(bare.values()) & old
    assert len(set(bare.values())) == len(names) and all(swapped[4 * i] == bare[n] for i, n in enumerate(names))


def test_all_parts_of_a_name_and_short_ones_are_taken():
    text = "Mr Carlos Antonio Ruiz Ortega came. Then Ortega and Mr Li left, said Li."
    new, found = surrogates.rewrite(text, surrogates.Surrogates(b"k"))
    assert [text[a:b] for a, b, _ in found] == ["Carlos Antonio Ruiz Ortega", "Ortega", "Li", "Li"]
    assert not {"Carlos", "Antonio", "Ruiz", "Ortega", "Li"} & set(new.replace(",", " ").replace(".", " ").split())


def test_lists_are_apart_and_alike():
    known = {n for names in surrogates.KNOWN_NAMES.values() for n in names}
    other = {n for names in surrogates.OTHER_NAMES.values() for n in names}
    assert not known & other
    assert all(len(names) == len(set(surrogates.OTHER_NAMES[kind])) == len(names) for kind, names in surrogates.KNOWN_NAMES.items())
    assert not any(n.endswith(e) for n in known | other for e in surrogates.ENDINGS.values())


def test_names_map_one_to_one_between_texts_and_keep_gender_and_script():
    s, seen = surrogates.Surrogates(b"k"), {}
    names = {kind: surrogates.KNOWN_NAMES[kind] for kind in surrogates.KNOWN_NAMES}
    for given in ("female", "male", "female-cyrillic", "male-cyrillic"):
        family = "family-cyrillic" if "cyrillic" in given else "family"
        for i, first in enumerate(names[given]):
            last = names[family][i % len(names[family])]
            new, found = surrogates.rewrite(f"{first} {last}, {last.upper()} or {first}", s)
            assert [k for _, _, k in found] == ["person"] * 2 if last.upper() not in first else True
            a, b = new.split(",")[0].split(" ")
            assert a in surrogates.OTHER_NAMES[given] and b in surrogates.OTHER_NAMES[family] and new.endswith(a)
            for old, got in ((first, a), (last, b)):
                assert seen.setdefault(old, got) == got
    assert len(set(seen.values())) == len(seen)


def slow_feistel(key, tweak, x, n):
    """The permutation's step by a table of the whole range, with the network written out again."""
    import hashlib

    secret = hashlib.blake2b(key, digest_size=32).digest()
    t, bits = f"{tweak}|{n}|".encode(), max(1, ((n - 1).bit_length() + 1) // 2)

    def network(v):
        left, right = divmod(v, 1 << bits)
        for i in range(surrogates.ROUNDS):
            h = hashlib.blake2b(t + bytes([i, 0]) + right.to_bytes((bits + 7) // 8, "big"), key=secret).digest()
            left, right = right, left ^ (int.from_bytes(h, "big") % (1 << bits))
        return left * (1 << bits) + right

    def walked(v):
        v = network(v)
        while v >= n:
            v = network(v)
        return v

    order = {walked(v): v for v in range(n)}
    return order[(walked(x) + 1) % n]


def test_rewriting_against_a_plain_version():
    s, rng = surrogates.Surrogates(b"k"), random.Random(16)
    for _ in range(20):
        a, b = rng.randrange(10), rng.randrange(10)
        value = f"{a}{b}"
        new, found = surrogates.rewrite(f"pin token={value} end", s)
        assert [k for _, _, k in found] == ["secret"]
        # a hexadecimal secret of two digits is one of 256 strings
        wanted = slow_feistel(b"k", "hex|" + chr(65 + 16) * 2, int(value, 16), 256)
        assert new == f"pin token={wanted:02x} end"


def test_coreference_and_distinctness_between_texts(spark):
    rng = random.Random(17)
    people = [f"{f} {l}" for f in surrogates.KNOWN_NAMES["female"] for l in surrogates.KNOWN_NAMES["family"]]
    cards = [c + str(surrogates.luhn(c)) for c in (f"4{rng.randrange(10**14):014d}" for _ in range(200))]
    texts = [f"{rng.choice(people)} met {rng.choice(people)}. Card {rng.choice(cards)}, mail a{i % 50}@x.org, ip 10.1.{i % 9}.{i % 200}." for i in range(400)]
    s, seen = surrogates.Surrogates(b"k"), {}
    for text in texts:
        new, found = surrogates.rewrite(text, s)
        for a, b, kind in found:
            now = s.of(kind, text[a:b])
            assert now in new and seen.setdefault((kind, text[a:b]), now) == now
    for kind in {k for k, _ in seen}:
        values = [v for (k, _), v in seen.items() if k == kind]
        assert len(values) == len(set(values))
    assert all(k != "person" or not set(v.split()) & {n for names in surrogates.KNOWN_NAMES.values() for n in names} for (k, _), v in seen.items())
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    assert surrogates.collisions(frame, b"k").count() == 0


@pytest.mark.parametrize(
    "text",
    ["Order 20240501123456 came", "Numbers 4111111111111112 and 9177399536541148", "Run version 1.2.3.4 or v1.2.3.4, release: 10.0.0.1", "ratio: 3:4", "1.2.3 and 1.2.3.4.5", "Anna went home"],
)
def test_what_is_no_entity_stays(text):
    assert surrogates.rewrite(text, surrogates.Surrogates(b"k")) == (text, [])


@pytest.mark.parametrize("text", ["Hans Mueller wrote", "with John Fitzgerald there", "hash " + "0a" * 66, "pwd=abc", "card 4111-1111-1111-1111.", "password=密码密码"])
def test_what_was_missed_is_taken(text):
    new, found = surrogates.rewrite(text, surrogates.Surrogates(b"k"))
    assert len(found) == 1
    a, b, _ = found[0]
    assert not any(part in new for part in re.split(r"[ .-]", text[a:b]) if len(part) > 1)


def test_a_key_is_needed():
    with pytest.raises(ValueError):
        surrogates.Surrogates(b"")
