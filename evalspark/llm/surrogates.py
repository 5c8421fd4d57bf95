"""Replaces personal data by surrogates of the same type.

Entities are found by patterns: e-mail addresses, IPv4 addresses, bank accounts (IBAN), social
security, card and phone numbers, and names behind a title. A surrogate is drawn with a secret key
(HMAC) from the entity's type and value, so one entity has one surrogate wherever it occurs, in any
notation: numbers keep their separators and country prefix, cards a valid check digit, letters keep case and
script, valid IBANs valid check digits, names keep gender and script, and e-mail addresses get a host
that is reserved for examples. Name parts are entities of their own, and a part found behind
a title, or several, is replaced wherever it stands in that document. Whether a part is a given name,
and of which gender, is settled for the whole table, so that it has one surrogate in all roles. A name
in a document without a title before it is not found.

Collision checks: the distinct entities of the table are counted once; where two of a type draw the
same surrogate, or one draws a value that occurs as an entity, all but the smallest draw again with
the next number, until all differ. Only entities that drew again or were settled otherwise travel to
the documents that have them.

A null text stays null and an empty one empty, with no entities. Rows equal in key and text are
treated alike. Other columns stay as they are, in a struct of their own.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.batches import map_texts
from evalspark.session import fresh_path

#: Draws after which the space of a type counts as exhausted.
MAX_DRAWS = 64

# Patterns by type, in the order in which they claim text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w+])(?!(?:19|20)\d\d[./-]\d\d?[./-]\d\d?(?!\d))(?!\d\d?[./-]\d\d?[./-](?:19|20)\d\d(?!\d))"
    r"(?:\+\d{8,15}|(?:\+\d{1,3}[ .-]?(?:\(\d{2,5}\)[ .-]?)?\d{1,8}|(?:\(\d{2,5}\)[ .-]?)?\d{2,8})"
    r"(?:[ ./-]\d{2,8}){1,5})(?!\w)",
}
# Titles by the gender they state.
TITLES = {
    "m": "Mr Mister Sir Herr Herrn Señor Sr Don Monsieur M Signor г-н господин κ κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Señora Sra Señorita Doña Madame Mme Mlle Signora г-жа госпожа κα".split(),
    "": "Dr Prof Professor Doktor Doctor".split(),
}
# Given and family names by script and gender.
NAMES = {
    ("latin", "m"): "Adrian Bruno Conrad Edgar Felix Gordon Hugo Ivo Julian Konrad Leon Marcel".split(),
    ("latin", "f"): "Agnes Bianca Clara Dora Edith Flora Greta Helena Irene Julia Karla Lydia".split(),
    ("latin", ""): "Abel Carter Dorn Ellis Falk Garner Holt Ibsen Jarvis Keller Lorenz Mercer".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Игорь Кирилл Леонид Максим".split(),
    ("cyrillic", "f"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия".split(),
    ("cyrillic", ""): "Белов Власов Гусев Дроздов Ершов Зимин Карпов Ларин Мельник Носов".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα".split(),
    ("greek", ""): "Αλεξίου Βλάχος Γεωργίου Δήμου Ζήσης Καρράς Λάμπρου Μάνος".split(),
}
SYLLABLES = {
    "latin": "ba co di fe gu ha ki lo ma ne pi ro su ta ve wi".split(),
    "cyrillic": "ба во ги де жу за ки ло ма не пи ро су та фе хи".split(),
    "greek": "βα γο δι ζε θα κι λο μα νε πι ρο σα τε φι χο ψα".split(),
}
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
# Scripts without names of their own: first and last of the letters that stand for others.
RANGES = {
    "hebrew": "את",
    "arabic": "بغ",
    "devanagari": "कह",
    "thai": "กฮ",
    "hiragana": "あん",
    "katakana": "アン",
    "han": "一龥",
    "hangul": "가힣",
}
ALPHABETS |= {s: "".join(map(chr, range(ord(a), ord(b) + 1))) for s, (a, b) in RANGES.items()}
_titles = sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)
NAME = re.compile(
    r"(?<!\w)(?P<titles>(?:(?:" + "|".join(map(re.escape, _titles)) + r")\.?[ \xa0])+)"
    r"(?P<name>[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[ \xa0-][^\W\d_a-zа-яα-ω][^\W\d_]+){0,2})"
)
TITLE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, _titles)) + r")(?!\w)")
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def script_of(text: str) -> str:
    first = next((c for c in text if c.isalpha()), "a")
    if "Ѐ" <= first <= "ԯ":
        return "cyrillic"
    if "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῿":
        return "greek"
    return next((s for s, (a, b) in RANGES.items() if a <= first <= b), "latin")


def luhn(digits: Sequence[int]) -> bool:
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def check_digits(iban: str) -> str:
    """The two digits that make the rest of an IBAN valid."""
    moved = iban[4:] + iban[:2] + "00"
    return f"{98 - int(''.join(str(int(c, 36)) for c in moved)) % 97:02}"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, in order, without overlap."""
    found = []
    if "@" in text or re.search(r"\d", text):
        for m in ENTITY.finditer(text):
            kind, value = m.lastgroup, m.group()
            digits = re.sub(r"\D", "", value)
            if kind == "phone" and not (7 <= len(digits) <= 15 and re.search(r"[ ./()+-]", value)):
                continue
            normal = {"email": value.lower(), "ip": value}.get(kind) or (
                re.sub(r"\s", "", value) if kind == "iban" else digits
            )
            found.append((m.start(), m.end(), kind, normal))
    parts: dict[str, str] = {}
    for m in NAME.finditer(text):
        # of several titles, one that states a gender
        gender = max(GENDER[t] for t in TITLE.findall(m["titles"]))
        names = list(re.finditer(r"[^\W\d_]+", m["name"]))
        for i, part in enumerate(names):
            given = i < len(names) - 1
            parts.setdefault(part.group(), f"given_{gender}" if given else "family")
    if parts:
        taken = [(a, b) for a, b, _, _ in found]
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, parts)) + r")(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((m.start(), m.end(), parts[m.group()], m.group()))
    return sorted(found)


class Draws:
    """A stream of numbers from the key, the type, the value and the number of the draw."""

    def __init__(self, key: bytes, kind: str, value: str, draw: int) -> None:
        self.key, self.label = key, f"{kind}\0{value}\0{draw}\0"
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            message = (self.label + str(self.block)).encode()
            self.left += hmac.digest(self.key, message, hashlib.sha256)
            self.block += 1
        number, self.left = int.from_bytes(self.left[:4]), self.left[4:]
        return number % n


def _alike(char: str, draws: Draws) -> str:
    """Another character of the same class, case and script."""
    if char.isdigit():
        return str(draws.below(10))
    if char.isalpha():
        alphabet = ALPHABETS[script_of(char)]
        letter = alphabet[draws.below(len(alphabet))]
        return letter.upper() if char.isupper() else letter
    return char


def surrogate(kind: str, value: str, key: bytes, draw: int = 0) -> str:
    """The surrogate of a normal form."""
    draws = Draws(key, kind, value, draw)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, _ = domain.rpartition(".")
        # the top-level domain is one that is reserved for examples, so that nobody is addressed
        return f"{''.join(_alike(c, draws) for c in local)}@{''.join(_alike(c, draws) for c in host)}.example"
    if kind == "ip":
        return ".".join(str(1 + draws.below(254)) for _ in range(4))
    if kind == "iban":
        drawn = value[:2] + "".join(_alike(c, draws) for c in value[2:])
        valid = check_digits(value) == value[2:4]
        return drawn[:2] + check_digits(drawn) + drawn[4:] if valid else drawn
    if kind in ("ssn", "card", "phone"):
        # a number of phone length keeps what may be its country's prefix
        keep = max(len(value) - 10, 0) if kind == "phone" else 0
        lead = str(1 + draws.below(9)) if value[keep : keep + 1] != "0" else "0"
        drawn = value[:keep] + lead + "".join(str(draws.below(10)) for _ in value[keep + 1 :])
        if kind == "card" and luhn([*map(int, value)]):
            body = drawn[:-1]
            drawn = next(body + d for d in "0123456789" if luhn([*map(int, body + d)]))
        return drawn
    script = script_of(value)
    if script in RANGES:
        return "".join(_alike(c, draws) for c in value)
    gender = kind.partition("_")[2] or ("" if kind == "family" else "mf"[draws.below(2)])
    pool = NAMES[script, gender]
    name = pool[draws.below(len(pool))]
    # further draws lengthen the name, so that there is always another one
    name += "".join(SYLLABLES[script][draws.below(16)] for _ in range(draw))
    return name.upper() if value.isupper() and len(value) > 1 else name


def render(kind: str, written: str, drawn: str) -> str:
    """The surrogate in the notation of the text."""
    if kind in ("ssn", "card", "phone", "iban"):
        rest = iter(drawn)
        return "".join(next(rest) if c.isalnum() else c for c in written)
    if kind == "email" and written.isupper():
        return drawn.upper()
    return drawn


def replace(
    text: str, key: bytes, again: dict[tuple[str, str], tuple[str, int]]
) -> tuple[str, list]:
    """The text with surrogates, and (start, end, type) of each in the new text.

    `again` has the type and the draw of entities for which they are not those of the text alone.
    """
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, value in find(text):
        settled, draw = again.get((kind, value), (kind, 0))
        new = render(kind, text[start:end], surrogate(settled, value, key, draw))
        out += (text[at:start], new)
        size += start - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = end
    return "".join((*out, text[at:])), spans


# ---- tables ----


def _written(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, version, kind, value): the distinct entities of each document."""

    def make() -> Callable[[list], list]:
        def run(texts: list) -> list:
            found = [sorted({(k, v) for _, _, k, v in find(t or "")}) for t in texts]
            return [[[k for k, _ in f] for f in found], [[v for _, v in f] for f in found]]

        return run

    rows = df.select(
        F.col(f"`{key}`").alias("doc"), F.xxhash64(f"`{text}`").alias("version"),
        F.col(f"`{text}`").alias("text"),
    )
    fields = {"kind": "array<string>", "value": "array<string>"}
    out = map_texts(rows, "text", make, fields, ("doc", "version"))
    pairs = F.inline(F.arrays_zip("out.kind", "out.value"))
    return out.select("kept.doc", "kept.version", pairs)


def drawn(entities: DataFrame, key: bytes, draw: int) -> DataFrame:
    """`entities` (kind, value) with the normal form of a draw in `surrogate`."""
    schema = "kind string, value string, surrogate string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = (c.to_pylist() for c in batch.columns)
            made = [surrogate(k, v, key, draw) for k, v in zip(kinds, values)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.string())], names=["kind", "value", "surrogate"]
            )

    return entities.select("kind", "value").mapInArrow(run, schema)


def _space(kind: str = "kind") -> Column:
    """Types whose surrogates must differ from each other: all kinds of name are one."""
    return F.when(F.col(kind).rlike("^(given|family)"), "name").otherwise(F.col(kind))


def draw_again(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, draw) of the distinct entities whose first surrogate is not theirs to keep."""
    entities = _written(entities.distinct(), "entities")
    originals = entities.select(_space().alias("space"), F.col("value").alias("surrogate")).distinct()
    spark = entities.sparkSession
    taken = spark.createDataFrame([], "space string, surrogate string")
    result = spark.createDataFrame([], "kind string, value string, draw int")
    left = entities
    for draw in range(MAX_DRAWS):
        new = _written(drawn(left, key, draw).withColumn("space", _space()), "drawn")
        free = new.join(originals, ["space", "surrogate"], "left_anti").join(
            taken, ["space", "surrogate"], "left_anti"
        )
        first = free.groupBy("space", "surrogate").agg(
            F.min(F.concat_ws("\0", "kind", "value")).alias("owner")
        )
        kept = _written(
            free.join(first, ["space", "surrogate"]).where(
                F.col("owner") == F.concat_ws("\0", "kind", "value")
            ),
            "kept",
        )
        left = _written(new.join(kept, ["kind", "value"], "left_anti").select("kind", "value"), "left")
        if draw:
            result = result.unionAll(kept.select("kind", "value", F.lit(draw).alias("draw")))
        if left.isEmpty():
            return result
        taken = taken.unionAll(kept.select("space", "surrogate"))
    raise RuntimeError(f"some entities have no free surrogate after {MAX_DRAWS} draws")


def settle(found: DataFrame) -> DataFrame:
    """`found` with the type `settled` that each value has in the whole table.

    A part of a name is a given name if at least half of its documents say so, else a family name;
    its gender is the one that most documents state, if any does. Other types stay as they are.
    """

    def votes(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, 1)).alias(kind)

    names = found.where(_space() == "name").groupBy("value").agg(
        *[votes(k) for k in ("given_m", "given_f", "given_", "family")]
    )
    given = F.col("given_m") + F.col("given_f") + F.col("given_") >= F.col("family")
    gender = F.when(F.col("given_m") + F.col("given_f") == 0, "given_").otherwise(
        F.when(F.col("given_m") > F.col("given_f"), "given_m").otherwise("given_f")
    )
    # written first, so that Spark knows its size when it chooses the join
    names = _written(
        names.select(
            F.lit("name").alias("space"),
            "value",
            F.when(given, gender).otherwise("family").alias("settled"),
        ),
        "settled",
    )
    joined = found.withColumn("space", _space()).join(names, ["space", "value"], "left")
    return joined.drop("space").withColumn("settled", F.coalesce("settled", "kind"))


def pseudonymize(
    df: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """For every row struct `kept` of its columns and struct `out` of `text`, with surrogates,
    `n_entities` and `spans` (start:end:type of each surrogate, in code points)."""
    found = settle(_written(mentions(df, key, text), "mentions"))
    entities = found.select(F.col("settled").alias("kind"), "value")
    again = _written(draw_again(entities, secret), "again").withColumnRenamed("kind", "settled")
    # written first, so that Spark knows its size when it chooses the join
    exceptions = _written(
        found.join(again, ["settled", "value"], "left")
        .where("draw is not null or settled != kind")
        .withColumn("draw", F.coalesce("draw", F.lit(0)))
        .groupBy("doc", "version")
        .agg(F.collect_list(F.struct("kind", "value", "settled", "draw")).alias("again")),
        "exceptions",
    ).withColumnsRenamed({"doc": "of_doc", "version": "of_version"})
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{key}`").alias("doc"),
        F.xxhash64(f"`{text}`").alias("version"),
        F.col(f"`{text}`").alias("text"),
    )
    same = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    joined = rows.join(exceptions, same, "left")

    def make() -> Callable[..., list]:
        def run(texts: list, kept: list) -> list:
            out = []
            for t, special in zip(texts, kept[1].to_pylist()):
                draws = {
                    (s["kind"], s["value"]): (s["settled"], s["draw"]) for s in special or ()
                }
                new, spans = replace(t or "", secret, draws)
                written = ",".join(f"{a}:{b}:{k}" for a, b, k in spans)
                out.append((None if t is None else new, len(spans), written))
            return [list(c) for c in zip(*out)]

        return run

    fields = {"text": "string", "n_entities": "int", "spans": "string"}
    made = map_texts(joined, "text", make, fields, ("row", "again"), True)
    return made.select(F.col("kept.row").alias("kept"), "out")
