"""Personal data: detected entities get keyed surrogates of the same type and format.

An entity is a text with parts: an e-mail address has a name and a domain, a person given names
and a surname, the others are one part. Each part is replaced by a draw from a keyed hash of its
type, value and attempt, so equal parts get equal surrogates in every document (coreference).
All different parts of the corpus are then checked in one table: a part whose surrogate is taken
by another one, or is itself a part that occurs, draws again until none is left, so different
parts stay different. The few that drew more than once are the only ones that are looked up.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dealflow.llm.common import chunks, columns, fresh, stored

CHUNK = 4 << 20

#: Forms of address, with the gender that they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m",
    "Sr": "m", "Don": "m", "г-н": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f",
    "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
    "Doña": "f", "г-жа": "f", "Госпожа": "f", "Dr": "", "Prof": "",
}
#: Common given names and surnames by script and gender.
GIVEN = {
    ("latin", "m"): "James Robert John Michael David William Thomas Daniel Paul Mark Peter Martin Lukas Jonas Felix Pierre Louis Hugo Carlos Javier Diego Pablo Marco Luca Anders Erik",
    ("latin", "f"): "Mary Patricia Linda Elizabeth Susan Sarah Karen Nancy Laura Anna Emma Julia Lena Sophie Claire Camille Manon Lucia Carmen Elena Marta Paula Chiara Giulia Ingrid Astrid",
    ("latin", ""): "Alex Robin Kim Sam Jamie Taylor Jordan Morgan Casey Riley Avery Quinn",
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана",
    ("cyrillic", ""): "Саша Женя Валя",
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία",
    ("greek", ""): "Άγγελος Αλέξης",
}
SURNAMES = {
    "latin": "Miller Davis Wilson Anderson Taylor Moore Jackson Martin Clark Lewis Walker Young Becker Hoffmann Schulz Wagner Dubois Moreau Laurent Lefevre Garcia Romero Navarro Ortega Rossi Ricci Berg Lind",
    "cyrillic": "Иванов Петров Смирнов Кузнецов Попов Васильев Соколов Морозов",
    "greek": "Παπαδόπουλος Γεωργίου Δημητρίου Νικολάου",
}
#: Syllables for names beyond the lists.
SYLLABLES = {
    "latin": "ba den for gal hem kin lor mar nes pol ral sten tor ven wil zan",
    "cyrillic": "ба ден гор кин лов мар нев пол рин сен тов вер",
    "greek": "αλ βερ γιο δημ θεο καλ λαμ μαν νικ παπ ρου σταθ",
}
HEX = "0123456789abcdef"
#: A phone number gets another digit for each so many draws that were taken.
LONGER = 16
LOWER = "abcdefghijklmnopqrstuvwxyz"

_title = "|".join(sorted(map(regex.escape, TITLES), key=len, reverse=True))
NAME = r"\p{Lu}[\p{L}'’-]+"
#: What may stand between a form of address and the name.
DEGREES = "Dr|Prof"
#: Endings of surnames of women, which men have without the last letter.
FEMININE = ("ова", "ева", "ёва", "ина", "ына")
PATTERNS = {
    "email": regex.compile(r"[\p{L}\d._%+-]+@[\p{L}\d-]+(?:\.[\p{L}\d-]+)+"),
    "secret": regex.compile(
        r"(?i)(?<!\p{L})(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
        r"\s?[=:]\s?[\"']?(?P<value>[^\s\"',;]{4,})"
    ),
    "iban": regex.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ipv4": regex.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    "card": regex.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "ssn": regex.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": regex.compile(
        r"(?<![\w.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
        r"|(?:1[ .-])?\d{3}(?P<between>[ .-])\d{3}(?P=between)\d{4}"
        r"|0\d(?:[ .-]\d{2}){4})(?![\w-]|\.\d)"
    ),
    "person": regex.compile(
        rf"(?<!\p{{L}})(?P<title>{_title})\.?(?: (?:{DEGREES})\.?)* (?P<value>{NAME}(?: {NAME}){{0,2}})"
    ),
}
#: A text without any of these characters cannot hold the type.
GUARDS: dict[str, Callable[[str], object]] = {
    "email": lambda t: "@" in t,
    "secret": lambda t: "=" in t or ":" in t,
    "person": regex.compile(rf"(?:{_title})\.? \p{{Lu}}").search,
}
DIGIT = regex.compile(r"\d").search


@dataclass(frozen=True)
class Settings:
    """``key`` decides all surrogates; up to ``look_up`` parts that drew again are sent to all
    tasks, more are joined. A part that finds no free surrogate in ``attempts`` is an error."""

    key: str = "dealflow"
    look_up: int = 50_000
    attempts: int = 64


@dataclass(frozen=True)
class Part:
    """Place of a part in a text, its kind (type and script or gender), and what tells it."""

    start: int
    end: int
    kind: str
    value: str


def script(text: str) -> str:
    if regex.search(r"\p{Cyrillic}", text):
        return "cyrillic"
    return "greek" if regex.search(r"\p{Greek}", text) else "latin"


def luhn(digits: str) -> int:
    """0 for a valid card number."""
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def iban_rest(value: str) -> int:
    """1 for a valid IBAN: its number modulo 97, letters being 10 to 35."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def parts_of(kind: str, match: regex.Match) -> list[Part]:
    text, start = match.group(), match.start()
    if kind == "email":
        at = match.start() + text.index("@")
        own, domain = text.split("@")
        return [
            Part(match.start(), at, "mailbox", own.lower()),
            Part(at + 1, match.end(), "domain", domain.lower()),
        ]
    if kind == "secret":
        # After a colon, prose is as likely as a secret; secrets have digits.
        if "=" not in text[: match.start("value") - start] and not DIGIT(match.group("value")):
            return []
        return [Part(*match.span("value"), "secret", match.group("value"))]
    if kind == "person":
        gender, at, out = TITLES[match.group("title")], match.start("value"), []
        names = match.group("value").split(" ")
        for i, name in enumerate(names):
            last = i == len(names) - 1
            role = f"surname:{script(name)}" if last else f"given:{script(name)}:{gender}"
            value = name.lower()
            if last and value.endswith(FEMININE):
                value = value[:-1]
            out.append(Part(at, at + len(name), role, value))
            at += len(name) + 1
        return out
    digits = regex.sub(r"[^\p{L}\d]", "", text)
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return []
        code = regex.match(r"\+(\d{1,3})(?!\d)", text)
        kind = f"phone:{len(code.group(1)) if code else 1}"
    if kind == "iban":
        kind = f"iban:{'valid' if iban_rest(digits) == 1 else 'plain'}"
    if kind == "ipv4":
        digits = ".".join(str(int(x)) for x in text.split("."))
    if kind == "card":
        kind = f"card:{len(digits)}:{'luhn' if luhn(digits) == 0 else 'plain'}"
    return [Part(start, match.end(), kind, digits)]


def mentions(text: str, known: dict[str, Part]) -> Iterator[list[Part]]:
    """Known surnames in ``text``, with the known given names before them."""
    of = {True: [], False: []}
    for name, part in known.items():
        of[part.kind.startswith("surname")].append(regex.escape(name))
    given = f"(?:(?:{'|'.join(of[False])}) )*" if of[False] else ""
    pattern = regex.compile(rf"(?<!\p{{L}}){given}(?:{'|'.join(of[True])})(?!\p{{L}})")
    for match in pattern.finditer(text):
        at, out = match.start(), []
        for name in match.group().split(" "):
            out.append(Part(at, at + len(name), known[name].kind, known[name].value))
            at += len(name) + 1
        yield out


def detected(text: str) -> list[list[Part]]:
    """Entities in order, as lists of parts; of overlapping ones that of the first type stays.

    A name that stands after a form of address is known in the whole text: its surname, alone or
    after its given names, is an entity without one too.
    """
    taken: list[tuple[int, int]] = []
    out = []
    known: dict[str, Part] = {}
    digits = DIGIT(text)
    for kind, pattern in PATTERNS.items():
        if not (GUARDS[kind](text) if kind in GUARDS else digits):
            continue
        for match in pattern.finditer(text):
            parts = parts_of(kind, match)
            if parts and all(match.end() <= a or match.start() >= b for a, b in taken):
                taken.append(match.span())
                out.append(parts)
                if kind == "person":
                    for part in parts:
                        for name in (text[part.start : part.end], text[part.start : part.end].upper()):
                            known.setdefault(name, part)
    if known:
        for parts in mentions(text, known):
            if all(parts[-1].end <= a or parts[0].start >= b for a, b in taken):
                out.append(parts)
    return sorted(out, key=lambda x: x[0].start)


class Draw:
    """Numbers below a bound from a keyed hash."""

    def __init__(self, key: str, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key.encode(), f"{kind}\0{value}\0{attempt}".encode("utf-8", "replace"), hashlib.sha256)
        self.count, self.pool = 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 32:
            more = self.seed.copy()
            more.update(self.count.to_bytes(4, "big"))
            self.pool, self.count = int.from_bytes(more.digest(), "big"), self.count + 1
        self.pool, out = divmod(self.pool, n)
        return out


def alike(draw: Draw, value: str, more: int) -> str:
    """Digits for digits and letters for letters, ``more`` of them behind the last letter."""
    letters = HEX[10:] if regex.fullmatch(r"[0-9a-f]{8,}", value) else LOWER
    out = ""
    for c in value + "a" * more:
        if c.isdigit():
            out += str(draw.below(10))
        elif c.isalpha():
            new = letters[draw.below(len(letters))]
            out += new.upper() if c.isupper() else new
        else:
            out += c
    return out


def surrogate(key: str, kind: str, value: str, attempt: int) -> str:
    """The value that stands for ``value`` at this attempt, in the plain form of the kind."""
    draw = Draw(key, kind, value, attempt)
    role, *rest = kind.split(":")
    if role in ("given", "surname"):
        names = (GIVEN[(rest[0], rest[1])] if role == "given" else SURNAMES[rest[0]]).split()
        if attempt < 3:
            return names[draw.below(len(names))].lower()
        syllables = SYLLABLES[rest[0]].split()
        return "".join(syllables[draw.below(len(syllables))] for _ in range(2 + attempt // 3))
    if role == "ipv4":
        first = (1 + draw.below(222)) or 1
        return ".".join(map(str, [first + (first >= 127), *(draw.below(256) for _ in range(3))]))
    if role == "domain":
        labels = value.split(".")
        return ".".join([*(alike(draw, x, attempt // 4) for x in labels[:-1]), labels[-1]])
    if role == "card":
        out = value[0] + "".join(str(draw.below(10)) for _ in value[1:])
        if rest[1] == "luhn":
            return next(out[:-1] + str(d) for d in range(10) if luhn(out[:-1] + str(d)) == 0)
        return out
    if role == "ssn":
        return "9" + "".join(str(draw.below(10)) for _ in value[1:])
    if role == "phone":
        code = int(rest[0])
        more = attempt // LONGER
        return value[:code] + "".join(str(draw.below(10)) for _ in range(len(value) - code + more))
    if role == "iban":
        if rest[0] == "plain":
            return value[:2] + alike(draw, value[2:], 0)
        body = alike(draw, value[4:], 0)
        return f"{value[:2]}{98 - iban_rest(f'{value[:2]}00{body}'):02d}{body}"
    return alike(draw, value, attempt // 4)


def shaped(plain: str, original: str, kind: str) -> str:
    """The plain form in the dress of the original: separators, or upper and title case."""
    role = kind.split(":")[0]
    if role in ("card", "ssn", "phone", "iban"):
        rest = iter(plain)
        return "".join(next(rest) if c.isalnum() else c for c in original) + "".join(rest)
    if role == "surname" and original.lower().endswith(FEMININE) and plain[-1] not in "аеёиоуыэюя":
        plain += "а"
    if role in ("given", "surname", "mailbox", "domain"):
        if len(original) > 1 and original.isupper():
            return plain.upper()
        return plain.title() if original[:1].isupper() else plain
    return plain


def replaced(text: str, settings: Settings, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and the number of entities."""
    found = detected(text)
    out, at = [], 0
    for part in (p for entity in found for p in entity):
        again = attempts.get((part.kind, part.value), 0)
        plain = surrogate(settings.key, part.kind, part.value, again)
        out += [text[at : part.start], shaped(plain, text[part.start : part.end], part.kind)]
        at = part.end
    return "".join([*out, text[at:]]), len(found)


def occurring(docs: DataFrame) -> DataFrame:
    """kind and value of all different parts in ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                own = {
                    (p.kind, p.value)
                    for t in part.column("text").to_pylist()
                    for entity in detected(t or "")
                    for p in entity
                }
                yield pa.record_batch(
                    {
                        "kind": pa.array([k for k, _ in own], pa.string()),
                        "value": pa.array([v for _, v in own], pa.string()),
                    }
                )

    return docs.mapInArrow(run, "kind string, value string").distinct()


def drawn(parts: DataFrame, settings: Settings) -> DataFrame:
    """``parts`` (kind, value, attempt) with their surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")))
            new = [surrogate(settings.key, *row) for row in rows]
            yield batch.append_column("surrogate", pa.array(new, pa.string()))

    return parts.mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def assigned(parts: DataFrame, settings: Settings) -> DataFrame:
    """kind, value, attempt, surrogate: no surrogate of a kind twice, and none that occurs.

    In each round, of the parts with an equal surrogate those that have it already, else the
    least by hash, keep it; the others draw again.
    """
    real = stored(parts, "parts")
    now = stored(drawn(real.withColumn("attempt", F.lit(0)), settings), "drawn")
    for attempt in range(1, settings.attempts + 1):
        best = F.min(F.struct("attempt", F.xxhash64("value").alias("h"), "value"))["value"]
        owners = now.groupBy("kind", "surrogate").agg(best.alias("owner"))
        occurs = real.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("occurs"))
        checked = now.join(owners, ["kind", "surrogate"]).join(occurs, ["kind", "surrogate"], "left")
        bad = F.col("occurs").isNotNull() | (F.col("owner") != F.col("value"))
        checked = stored(checked.withColumn("bad", bad).drop("owner", "occurs"), "checked")
        again = checked.filter("bad").select("kind", "value", F.lit(attempt).alias("attempt"))
        if again.isEmpty():
            return checked.drop("bad")
        good = checked.filter("not bad").drop("bad")
        now = stored(good.unionByName(drawn(again, settings)), "drawn")
    kinds = [r[0] for r in again.select("kind").distinct().limit(5).collect()]
    raise ValueError(f"no free surrogates for parts of the kinds {kinds}")


def surrogated(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and, as last column, n_entities.

    Detected are e-mail addresses, values after words like password, IBANs, IPv4 addresses, card
    and social security numbers, phone numbers, and names after a form of address, with later
    mentions of their surnames in the same text. Gender is that of the address, script that of
    the name (other scripts than Latin, Cyrillic and Greek get Latin names); surnames of women
    keep their ending. Card numbers and IBANs stay valid, country codes stay. Where all numbers
    of a length are taken, phone numbers get longer, as names do. Null texts stay null with 0 entities; texts
    without entities, and everything around an entity, stay as they are. Repeated rows get
    equal results. No rows in, no rows out.
    """
    final = stored(assigned(occurring(columns(docs, text=text)), settings).filter("attempt > 0"))
    few = final.count() <= settings.look_up
    count, fixes = fresh(docs, "n_entities"), fresh(docs, "fixes")
    known = {(r[0], r[1]): r[2] for r in final.select("kind", "value", "attempt").collect()} if few else {}
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, CHUNK):
                own = part.column(fixes).to_pylist() if fixes in part.schema.names else None
                new, found = [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    again = shared.value
                    if own and own[i]:
                        again = {(f["kind"], f["value"]): f["attempt"] for f in own[i]}
                    t, n = (None, 0) if t is None else replaced(t, settings, again)
                    new.append(t)
                    found.append(n)
                cells = [part.column(c) if c != text else pa.array(new, pa.string()) for c in names]
                yield pa.record_batch([*cells, pa.array(found, pa.int64())], [*names, count])

    rows = docs if few else with_fixes(docs, final, text, fixes)
    schema = StructType([*docs.schema.fields, StructField(count, LongType())])
    return rows.mapInArrow(run, schema)


def with_fixes(docs: DataFrame, final: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the list of those of its parts that drew more than once."""
    key = fresh(docs, "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                keys = part.column("key").to_pylist()
                own = {
                    (k, p.kind, p.value)
                    for k, t in zip(keys, part.column("text").to_pylist(), strict=True)
                    for entity in detected(t or "")
                    for p in entity
                }
                cells = [pa.array([x[i] for x in own], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.record_batch(cells, ["key", "kind", "value"])

    texts = columns(docs, text=text).withColumn("key", F.xxhash64("text"))
    parts = texts.mapInArrow(run, "key long, kind string, value string").distinct()
    lists = parts.join(final.select("kind", "value", "attempt"), ["kind", "value"]).groupBy("key")
    lists = lists.agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(name))
    lists = lists.withColumnRenamed("key", key)
    return docs.withColumn(key, F.xxhash64(F.col(f"`{text}`"))).join(lists, key, "left").drop(key)
