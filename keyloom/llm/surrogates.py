"""PII surrogates: detected entities are replaced by keyed, made-up ones of the same type, format, script and gender.

Kinds: email, phone, card, ssn, iban, ipv4, aws_key, secret (values assigned to password, token and the like), hex_token,
and person names (behind an honorific, or a known given name before a known family name; further mentions
of these names in the same text follow).

Every kind but names is mapped by one keyed permutation without fixed points of all values of its format: x goes to
P^-1(P(x) + 1), P being a Feistel network, walked along its cycle while it leaves the format. Check digits (Luhn, ISO 7064) are
made anew, letter case and separators stay. Known given names go one to one to others of their gender and script, known family
names to others of their script, all of these from lists that share no name with the known ones; every other name goes
to one of the same pattern of vowels and consonants with an ending that no listed name has. So the mapping is one to one in
each kind: in the whole corpus one entity has one surrogate, however it is written (coreference), two never share one
(distinctness), and none keeps its value, with no table of the corpus and no exceptions within a text. `collisions`
checks this over a corpus. A surrogate may by chance be spelled like another entity's original (for a card of 16 digits
once in 10^15); that one has a surrogate of its own, so they stay distinct.

Without the key no surrogate can be traced back. It is an argument; the queries take it from the session's setting
`spark.keyloom.surrogates.key`, or make a random one for the application.

What is no entity: digits that fail the Luhn test or begin as no card does, four numbers behind a word for a version.

Defined results: a null text stays null, an empty one empty, with no entities. Where candidates overlap, the one that
starts first counts, then the kind listed first. Repeated rows each get a row. An empty table gives an empty result.
Extra columns are ignored by `replace_pii` and kept by `scrub`.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, replace_text, strides

SETTING = "spark.keyloom.surrogates.key"
ROUNDS = 8

LOWER = "abcdefghijklmnopqrstuvwxyz"
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
DIGITS = "0123456789"
#: Letters that are permuted among their like; the letter's case is kept.
ALPHABETS = [
    LOWER,
    DIGITS,
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœ",
    "āăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňŋōŏőŕřśŝşšţťŧũūŭůűųŵŷźżž",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
    *("".join(map(chr, range(a, b + 1))) for a, b in [(0x5D0, 0x5EA), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]),
]
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
KNOWN_NAMES = {
    "female": "Alice Anna Barbara Carla Clara Diana Elena Elisabeth Emma Eva Fiona Gabriela Hannah Helena Isabel Jane Julia Karen Laura Linda Lucia Maria Marie Martha Mary Nina Olivia Patricia Rosa Sarah Sofia Susan Teresa Ursula Victoria Zoe",
    "male": "Adam Albert Alexander Andrew Anton Antonio Bernard Carlos Charles Daniel David Diego Edward Felix Francis Frank George Hans Henry Hugo Jacob James Jean John Jorge Joseph Juan Karl Louis Luis Martin Michael Miguel Oliver Otto Paul Peter Pierre Robert Thomas Walter William",
    "female-cyrillic": "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия",
    "male-cyrillic": "Александр Алексей Андрей Борис Виктор Дмитрий Иван Николай Павел Сергей",
    "family": "Anderson Bauer Becker Brown Clark Davis Dubois Durand Fernandez Fischer Garcia Gomez Hoffmann Jackson Johnson Jones Klein Koch Lambert Laurent Lewis Lopez Martinez Meyer Miller Moore Moreau Morgan Muller Navarro Neumann Parker Perez Petit Richter Robinson Rodriguez Roux Sanchez Schmidt Schneider Schulz Simon Smith Taylor Torres Vega Wagner Weber White Williams Wilson Wolf Young Zimmermann",
    "family-cyrillic": "Васильев Волков Иванов Козлов Кузнецов Лебедев Морозов Новиков Петров Попов Смирнов Соколов Фёдоров",
}
#: Names for the known ones of the same list: as many, and no known one among them.
OTHER_NAMES = {
    "female": "Adela Agatha Beatrix Bianca Camille Celeste Dorothea Edith Eleanor Flora Frieda Greta Ingrid Irene Jolanda Katja Leonie Louisa Mabel Margot Matilda Nadia Noemi Paula Philippa Regina Rosalind Ruth Silvia Stella Thea Valeria Vera Viola Wilma Yvonne",
    "male": "Alan Alfred Arthur August Basil Benedict Bruno Claude Conrad Cyril Dominic Edgar Emil Eric Ernest Eugene Ferdinand Gilbert Gregor Gustav Harold Harvey Herbert Ignacio Ivo Jasper Julius Kurt Lambertus Leopold Lothar Magnus Marcel Norbert Oscar Ralph Raymond Roland Rupert Stanley Theodor Victor",
    "female-cyrillic": "Алла Валентина Вера Галина Дарья Зоя Инна Лариса Маргарита Тамара",
    "male-cyrillic": "Антон Вадим Василий Геннадий Егор Захар Кирилл Лев Максим Степан",
    "family": "Abbott Albrecht Arnaud Barker Baxter Benitez Blanchard Brandt Bright Calder Carver Castillo Chandler Dalton Delgado Dietrich Drake Ellwood Engel Fabre Fletcher Fontaine Frost Gallagher Gruber Haas Hartwig Herrera Holland Ibarra Jansen Keller Kramer Lacroix Lindner Marchand Mercer Mendoza Nolan Norris Ochoa Pascal Pfeiffer Quinn Ramos Renard Sauer Sherman Sutter Thornton Ulrich Vargas Voss Whitaker Winkler",
    "family-cyrillic": "Алексеев Беляев Воробьёв Григорьев Данилов Егоров Жуков Зайцев Ковалёв Макаров Орлов Романов Титов",
}
KNOWN_NAMES, OTHER_NAMES = ({kind: names.split() for kind, names in lists.items()} for lists in (KNOWN_NAMES, OTHER_NAMES))
LISTED = {name.lower(): (kind, at) for kind, names in KNOWN_NAMES.items() for at, name in enumerate(names)}
#: Endings of the surrogates of all other names, by script: no name of the lists has them.
ENDINGS = {LOWER: "wend", ALPHABETS[4]: "венд", ALPHABETS[5]: "βενδ"}

WORD = r"[^\W\d_]"
NAME = rf"(?:[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]{WORD}+(?:-[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]{WORD}+)?)"
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Г-н|Г-жа)"
PATTERNS: list[tuple[str, str, re.Pattern[str], tuple[str, ...]]] = [
    # kind, what a text must hold (any of these characters; none: no such test), pattern with the value in group v, other needles
    ("email", "@", re.compile(r"(?P<v>[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"), ()),
    ("secret", "=:", re.compile(r"(?i)\b(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[^\s\"',;]+)"), ()),
    ("aws_key", "", re.compile(r"\b(?:AKIA|ASIA|akia|asia)(?P<v>[A-Z0-9]{16}|[a-z0-9]{16})\b"), ("AKIA", "ASIA", "akia", "asia")),
    ("iban", "0123456789", re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"), ()),
    ("ipv4", "0123456789", re.compile(r"(?<![\w.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d|[^\W\d_])"), ()),
    ("phone", "0123456789", re.compile(r"(?<![\w.])(?P<v>(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-])"), ()),
    ("ssn", "-", re.compile(r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])"), ()),
    ("card", "0123456789", re.compile(r"(?<![\w.])(?P<v>\d(?:[ -]?\d){12,18})(?!\w|\.\d)"), ()),
    ("hex_token", "0123456789", re.compile(r"(?<!\w)(?P<v>(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?!\w)"), ()),
]
TITLED = re.compile(rf"\b{TITLE}\.? (?P<v>{NAME}(?: {NAME})*)")
GIVEN = "|".join(n for kind, names in KNOWN_NAMES.items() if not kind.startswith("family") for n in names)
KNOWN = re.compile(rf"\b(?P<v>(?:{GIVEN}) {NAME})(?!\w)")
VERSION = re.compile(r"(?i)(?:\b(?:version|release|build|ver|rev|section|chapter|firmware)\.?|\bv\.?)[ :=]{0,2}$")


class Permutation:
    """Keyed permutations without fixed points of range(n), one for each n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        digest = b""
        while len(digest) * 8 < bits:
            data = tweak + bytes([i, len(digest) & 255]) + half.to_bytes((bits + 7) // 8, "big")
            digest += hashlib.blake2b(data, key=self.key).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _network(self, tweak: bytes, x: int, bits: int, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, i, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, i, right, bits)
        return left << bits | right

    def _walk(self, tweak: bytes, x: int, n: int, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._network(tweak, x, bits, back)
            if x < n:
                return x

    def move(self, tweak: str, x: int, n: int) -> int:
        if n < 2:
            return x
        t = f"{tweak}|{n}|".encode()
        return self._walk(t, (self._walk(t, x, n, False) + 1) % n, n, True)


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _lower(text: str) -> str:
    """The text in lower case, character by character."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _kinds(text: str) -> list[str]:
    """The alphabet that each character is drawn from; '' for one that stays."""
    return [ALPHABET_OF.get(c, "") for c in _lower(text)]


def _looks_like(kind: str, text: str, start: int, end: int) -> bool:
    """What a pattern can't tell: whether digits can be a card's number, and four numbers an address."""
    if kind == "card":
        digits = re.sub(r"\D", "", text[start:end])
        return digits[0] in "23456" and int(digits[-1]) == luhn(digits[:-1])
    return kind != "ipv4" or not VERSION.search(text, max(0, start - 12), start)


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.permutation = Permutation(key)
        self.memo: dict[tuple[str, str], str] = {}

    def mix(self, tweak: str, text: str, alphabets: list[str]) -> str:
        """text with its characters moved together through all strings of the same alphabets, case kept."""
        lower = _lower(text)
        x, n = 0, 1
        for c, a in zip(lower, alphabets):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        x = self.permutation.move(f"{tweak}|{''.join(chr(65 + len(a)) for a in alphabets if a)}", x, n)
        out, shout = [], text.isupper()
        for c, a in zip(reversed(text), reversed(alphabets)):
            if a:
                x, at = divmod(x, len(a))
                # where digits and letters mix, only the case of the whole can be kept
                out.append(a[at].upper() if (shout if a[0] == "0" else c.isupper()) else a[at])
            else:
                out.append(c)
        return "".join(reversed(out))

    def of(self, kind: str, value: str) -> str:
        key = (kind, value)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = getattr(self, f"_{kind}")(kind, value)
        return self.memo[key]

    def _email(self, tweak: str, value: str) -> str:
        head, dot, top = value.rpartition(".")
        return self.mix(tweak, head, _kinds(head)) + dot + top

    def _secret(self, tweak: str, value: str) -> str:
        if re.fullmatch(r"[0-9a-fA-F]+", re.sub(r"\W+$", "", value)):
            return self._hex_token(tweak, value)
        return self.mix(tweak, value, _kinds(value))

    def _hex_token(self, tweak: str, value: str) -> str:
        return self.mix("hex", value, ["0123456789abcdef" if c.isascii() and c.isalnum() else "" for c in value])

    def _aws_key(self, tweak: str, value: str) -> str:
        return self.mix(tweak, value, ["0123456789" + LOWER] * len(value))

    def _phone(self, tweak: str, value: str) -> str:
        # the country code stays
        code = re.match(r"\+\d{1,3}(?=[^\d])|\d{1,3}(?=[ .-]?\()", value)
        kept = code.end() if code else 0
        return value[:kept] + self.mix(tweak, value[kept:], _kinds(value[kept:]))

    def _ssn(self, tweak: str, value: str) -> str:
        return self.mix(tweak, value, _kinds(value))

    def _ipv4(self, tweak: str, value: str) -> str:
        x = 0
        for part in value.split("."):
            x = x << 8 | int(part)
        x = self.permutation.move(tweak, x, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _card(self, tweak: str, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        # the first digit, which tells the kind of card, stays
        body = digits[0] + self.mix(tweak + digits[0], digits[1:-1], _kinds(digits[1:-1]))
        new = iter(body + str(luhn(body)))
        return "".join(next(new) if c.isdigit() else c for c in value)

    def _iban(self, tweak: str, value: str) -> str:
        solid = value.replace(" ", "")
        numeric = lambda s: int("".join(str(int(c, 36)) for c in s))
        off = numeric(solid[4:] + solid[:4]) % 97
        body = self.mix(tweak, solid[4:], _kinds(solid[4:]))
        check = (off - numeric(body + solid[:2] + "00")) % 97
        new = iter(solid[:2] + f"{check:02d}" + body)
        return "".join(next(new) if c != " " else c for c in value)

    def _person(self, tweak: str, value: str) -> str:
        return " ".join(self.name(part) for part in value.split(" "))

    def name(self, part: str) -> str:
        if listed := LISTED.get(part.lower()):
            kind, at = listed
            new = OTHER_NAMES[kind][self.permutation.move(f"name|{kind}", at, len(OTHER_NAMES[kind]))]
        else:
            alphabets = [VOWELS if c in VOWELS else CONSONANTS if c in CONSONANTS else a for c, a in zip(_lower(part), _kinds(part))]
            new = self.mix("name", part, alphabets) + ENDINGS.get(next(filter(None, _kinds(part)), LOWER), ENDINGS[LOWER])
        return new.upper() if len(part) > 1 and part.isupper() else new


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, in order, without overlaps."""
    found: list[tuple[int, int, int, str]] = []
    for rank, (kind, needs, pattern, needles) in enumerate(PATTERNS):
        if (needs and not any(c in text for c in needs)) or (needles and not any(n in text for n in needles)):
            continue
        found += [(*m.span("v"), rank, kind) for m in pattern.finditer(text) if _looks_like(kind, text, *m.span("v"))]
    names = [(*m.span("v"), 99, "person") for p in (TITLED, KNOWN) for m in p.finditer(text)]
    if names:
        parts = sorted({p for a, b, _, _ in names for p in text[a:b].split(" ")}, key=len, reverse=True)
        found += names
        found += [(*m.span(), 100, "person") for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, parts))})\b", text)] if parts else []
    out, end = [], 0
    for a, b, _, kind in sorted(found, key=lambda x: (x[0], x[2], -x[1])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def plain(kind: str, value: str) -> str:
    return re.sub(r"\W", "", value).lower() if kind != "ipv4" else value


def rewrite(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with all entities replaced, and what was found where in the original."""
    found = detect(text)
    if not found:
        return text, found
    new = [surrogates.of(kind, text[a:b]) for a, b, kind in found]
    out, at = [], 0
    for (a, b, _), n in zip(found, new):
        out += [text[at:a], n]
        at = b
    return "".join([*out, text[at:]]), found


def _worker(key: bytes) -> Callable[[str], tuple[str, list[tuple[int, int, str]]]]:
    surrogates = Surrogates(key)
    return lambda text: rewrite(text, surrogates)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, or else a random one, the same for all of the application."""
    given = spark.conf.get(SETTING, None)
    return given.encode() if given else _made.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


_made: dict[str, bytes] = {}


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities, and entities as (kind, n) in the kinds' order."""

    def make():
        work_on = _worker(key)

        def work(batch: pa.RecordBatch):
            texts, kinds = [], []
            for text in batch.column(1).to_pylist():
                new, found = work_on(text) if text else (text, [])
                texts.append(new)
                kinds.append([{"kind": k, "n": n} for k, n in sorted(Counter(k for _, _, k in found).items())])
            return {
                "doc_id": batch.column(0),
                "text": pa.array(texts, pa.string()),
                "n_entities": pa.array([sum(k["n"] for k in ks) for ks in kinds], pa.int64()),
                "entities": pa.array(kinds, pa.list_(pa.struct([("kind", pa.string()), ("n", pa.int64())]))),
            }

        return work

    schema = "doc_id long, text string, n_entities long, entities array<struct<kind: string, n: bigint>>"
    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), schema, make)


def scrub(docs: DataFrame, key: bytes) -> DataFrame:
    """docs, all rows and columns kept, with surrogates in its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work_on = _worker(key)
        for batch in strides(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            yield replace_text(batch, [work_on(t)[0] if t else t for t in column.to_pylist()])

    return docs.mapInArrow(run, docs.schema)


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate): surrogates, as digests, that stand for two entities of a kind or more; there are none."""

    def make():
        surrogates = Surrogates(key)

        def work(batch: pa.RecordBatch):
            pairs = {(kind, plain(kind, text[a:b]), plain(kind, surrogates.of(kind, text[a:b]))) for text in filter(None, batch.column(0).to_pylist()) for a, b, kind in detect(text)}
            columns = list(zip(*pairs)) or [()] * 3
            return dict(zip(("kind", "original", "surrogate"), [pa.array(c, pa.string()) for c in columns]))

        return work

    pairs = map_columns(docs.select("text"), "kind string, original string, surrogate string", make)
    pairs = pairs.select("kind", F.xxhash64("original").alias("original"), F.sha2("surrogate", 256).alias("surrogate"))
    return pairs.groupBy("kind", "surrogate").agg(F.min("original").alias("low"), F.max("original").alias("high")).where("low <> high").select("kind", "surrogate")
