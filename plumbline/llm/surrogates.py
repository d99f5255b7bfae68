"""Replacing personal data by surrogates.

Detected entities get replacements that are drawn from a keyed hash, so that one entity has one surrogate everywhere
(coreference) and nobody without the key can tell. A surrogate has its entity's type, script, letter case and format:
letters become letters, digits digits, separators stay, addresses stay valid, card numbers keep their length and check digit,
and given names keep their gender. Surrogates of all distinct entities are compared with one another and with all entities
found; of those that clash, all but one draw again, until every entity has a surrogate of its own.

Defined cases. A null text stays null, with no entities. The same entity in several writings (spaces, letter case or digits
of another script) shares one draw. Overlapping findings go to the earlier, then to the longer one. Repeated rows get equal results. An empty table gives
an empty result. Only doc_id and text are read by ``replaced``; other columns are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import attach, map_steps, stored, unused

# Given names by gender and script, for titles that tell the gender.
GIVEN = {
    ("f", "latin"): "Alice Anna Clara Diana Elena Emma Eva Grace Hanna Helen Ida Irene Julia Karen Laura Lea Maria Nina Olga Paula Rita Rosa Sara Sofia Vera".split(),
    ("m", "latin"): "Adam Alan Bruno Carl Daniel David Emil Erik Felix Frank Georg Hugo Ivan Jan Karl Leo Mark Martin Noah Oscar Paul Peter Simon Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Иван Олег Павел Пётр Роман Сергей Юрий".split(),
}
# Titles and the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
          "Srta": "f", "Doña": "f", "г-н": "m", "г-жа": "f"}
# After so many draws an entity may get a value that another entity had: its format has hardly any other value left.
DENSE = 24
_NAME = r"[^\W\d_a-zà-öø-ÿа-я][^\W\d_]+(?:[-'’][^\W\d_]+)?"
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]*[=:][ \t]*[\"']?(?P<secret_value>[^\s\"',;]{6,})",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.])\+\d{8,15}(?!\w)",
    "person": rf"(?:(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[  ])(?P<person_value>{_NAME}(?: {_NAME})?)",
}


@cache
def _finder() -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))


# What the numbers of the large card brands start with, and their lengths.
CARD_BRANDS = re.compile(
    r"(4)(?=\d{12}$|\d{15}$|\d{18}$)|(5[1-5])(?=\d{14}$)|(222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)(?=\d{12}$)|(3[47])(?=\d{13}$)"
    r"|(3(?:0[0-5]|[68]\d))(?=\d{11}$)|(35(?:2[89]|[3-8]\d))(?=\d{12}$)|(6011|64[4-9]\d|65\d\d)(?=\d{12}$)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


_SIGNS = re.compile(r"[\d@]")
# Each match of the patterns has a digit of any script, an at sign, the start of an access key, a title, or one of these words in
# any case; folding also covers the letters (long s, Kelvin sign) that the patterns' (?i:) takes for others.
_STARTS = ("AKIA", "ASIA", *TITLES)
_WORDS = ("passw", "pwd", "secret", "token", "key")


def _may_hold(text: str) -> bool:
    """Whether a text has what every entity has; far cheaper than the patterns."""
    if _SIGNS.search(text) or any(t in text for t in _STARTS):
        return True
    folded = text.casefold()
    return any(w in folded for w in _WORDS)


def _plain_digits(text: str) -> str:
    """The text with ASCII digits for those of other scripts."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _digit_like(c: str, digit: str) -> str:
    """An ASCII digit in the script of the digit c."""
    return chr(ord(c) - unicodedata.decimal(c) + int(digit))


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities in a text, from left to right. A name's type has its gender.

    No entity spans lines, so only lines that may hold one are searched.
    """
    if not _may_hold(text):
        return []
    out, start = [], 0
    for line in text.split("\n"):
        if _may_hold(line):
            out.extend((a + start, b + start, kind, value) for a, b, kind, value in _in_line(line))
        start += len(line) + 1
    return out


def _in_line(text: str) -> list[tuple[int, int, str, str]]:
    out, at = [], 0
    finder = _finder()
    while found := finder.search(text, at):
        kind = found.lastgroup if found.lastgroup in PATTERNS else next(k for k in PATTERNS if found.group(k) is not None)
        start, end = found.span(f"{kind}_value" if kind in ("secret", "person") else kind)
        value = text[start:end]
        at = max(end, found.start() + 1)
        if kind == "card":
            digits = _plain_digits(re.sub(r"\D", "", value))
            if not (luhn(digits) and CARD_BRANDS.match(digits)):
                at = found.start() + 1
                while at < len(text) and text[at].isdigit():
                    at += 1
                continue
            out.append((start, end, kind, digits))
        elif kind == "person":
            gender = TITLES[found.group("title")]
            for part in re.finditer(r"\S+", value):
                last = part.end() == len(value)
                out.append((start + part.start(), start + part.end(), "surname" if last else f"given_{gender}", part.group()))
        elif kind in ("phone", "iban"):
            out.append((start, end, kind, _plain_digits(re.sub(r"[^\dA-Z+]", "", value))))
        elif kind in ("ssn", "ip"):
            out.append((start, end, kind, _plain_digits(value)))
        else:
            out.append((start, end, kind, value.lower() if kind == "email" else value))
    return out


class _Draws:
    """Numbers from a keyed hash of an entity and the attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.block, self.pool = key, f"{kind}\x00{value}\x00{attempt}\x00".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + str(self.block).encode(), hashlib.sha256)
            self.block += 1
        raw, self.pool = self.pool[:4], self.pool[4:]
        return int.from_bytes(raw, "big") % n

    def letter(self, c: str) -> str:
        """A letter of the same script and case, a digit for a digit, other characters as they are."""
        if c.isdecimal():
            return _digit_like(c, str(self.below(10)))
        for low, high in (("a", "z"), ("A", "Z"), ("α", "ω"), ("Α", "Ω"), ("а", "я"), ("А", "Я")):
            if low <= c <= high:
                drawn = chr(ord(low) + self.below(ord(high) - ord(low) + 1))
                return {"ς": "σ", "΢": "Σ"}.get(drawn, drawn)
        if c.isalpha():
            return (str.upper if c.isupper() else str.lower)(chr(ord("a") + self.below(26)))
        return c


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    draws = _Draws(key, kind, value, attempt)
    # Values of free length grow when short ones run out.
    longer = "".join(draws.letter("a") for _ in range(attempt // 8))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        # Names that nobody can own: example.com, .net and .org stay, other domains move below .example.
        fixed = labels[-2:] if labels[-2] == "example" and labels[-1] in ("com", "net", "org") else ["example"]
        drawn = ["".join(map(draws.letter, x)) for x in labels[:len(labels) - len(fixed)]]
        return f"{''.join(map(draws.letter, local))}{longer}@{'.'.join([*drawn, *fixed])}"
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        digits = "0123456789ABCDEF" if re.search("[A-F]", value) else "0123456789abcdef"
        return "".join(digits[draws.below(16)] for _ in value + longer)
    if kind == "ip":
        return ".".join(str(1 + draws.below(254)) for _ in range(4))
    if kind == "access_key":
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        return value[:4] + "".join(alphabet[draws.below(32)] for _ in value[4:])
    if kind == "card":
        brand = CARD_BRANDS.match(value)
        start = brand[0] if brand else value[0]
        body = start + "".join(str(draws.below(10)) for _ in value[len(start):-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "ssn":
        return f"{1 + draws.below(665):03d}-{1 + draws.below(99):02d}-{1 + draws.below(9999):04d}"
    if kind == "phone":
        country = 2 if value.startswith("+") else 0
        national = [str(draws.below(10)) for _ in value[country:]]
        if len(national) >= 7:
            national[0] = str(2 + draws.below(8))
            # The exchange 555 is for invented numbers.
            if attempt < 8 and value[-7:-4] == "555":
                national[-7:-4] = "555"
        return value[:country] + "".join(national)
    if kind == "iban":
        body = "".join(map(draws.letter, value[4:]))
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind.startswith("given_"):
        script = "cyrillic" if re.search("[а-яё]", value, re.I) else "latin"
        names = GIVEN[(kind[-1], script)]
        # Beyond the list, a name of the list and a drawn ending keep gender and distinctness.
        name = names[draws.below(len(names))]
        return name if attempt < 4 else name + "".join(draws.letter("а" if script == "cyrillic" else "a") for _ in range(1 + attempt // 8))
    return "".join(map(draws.letter, value)) + (longer if kind != "access_key" else "")


def written(canonical: str, kind: str, original: str) -> str:
    """The surrogate in the writing of the place it goes to."""
    if kind in ("card", "phone", "iban"):
        signs = iter(canonical)
        drawn = (next(signs) if c.isalnum() or c == "+" else c for c in original)
        return "".join(_digit_like(c, d) if c.isdecimal() else d for c, d in zip(original, drawn))
    if kind in ("ssn", "ip") and not original.isascii():
        script = next(c for c in original if c.isdecimal() and not c.isascii())
        return "".join(_digit_like(script, d) if d.isdecimal() else d for d in canonical)
    if kind == "email" and original != original.lower():
        return canonical.upper() if original == original.upper() else canonical.capitalize()
    return canonical


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, kinds, values = [], [], []
    for i, text in enumerate(batch.column("_text").to_pylist()):
        for kind, value in sorted({(k, v) for _, _, k, v in entities(text)}):
            rows.append(i)
            kinds.append(kind)
            values.append(value)
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("_id").take(at), batch.column("_mark").take(at), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
        names=["_id", "_mark", "kind", "value"])


def distinct_surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) with a surrogate of its own for each distinct entity. values: kind, value, distinct."""
    def drawing(attempt: int):
        def run(batches):
            for batch in batches:
                drawn = [surrogate(key, k, v, attempt) for k, v in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(drawn, pa.string())], names=["kind", "value", "surrogate"])
        return run

    schema = "kind string, value string, surrogate string"
    settled, open_, attempt = None, values, 0
    while True:
        drawn = open_.mapInArrow(drawing(attempt), schema)
        # Names of either gender share one space: no given name stands for two people.
        space = F.regexp_replace("kind", "^given_.", "given")
        drawn = stored(drawn.withColumn("space", space), "surrogate-drawn")
        taken = settled.select("space", "surrogate") if settled is not None else drawn.select("space", "surrogate").limit(0)
        if attempt < DENSE:
            taken = taken.union(values.select(space.alias("space"), F.col("value").alias("surrogate")))
        least = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "value")).alias("first")).join(
            taken, ["space", "surrogate"], "left_anti").select("first.*")
        won = drawn.join(least, ["kind", "value"], "left_semi")
        settled = stored(won if settled is None else settled.unionByName(won), "surrogate-settled")
        open_ = stored(open_.join(settled, ["kind", "value"], "left_anti").select("kind", "value"), "surrogate-open")
        attempt += 1
        if attempt > 10 * DENSE:
            raise ValueError("the formats of the entities leave too few surrogates")
        if open_.isEmpty():
            return settled.select("kind", "value", "surrogate")


def replaced(docs: DataFrame, key: bytes, count: str = "n_entities") -> DataFrame:
    """The table with surrogates for the entities in ``text``, and a column with their number.

    A column of the table that has the name of that one is replaced.
    """
    docs = docs.drop(count)
    own, id_, mark, map_ = unused(docs, "own", "id", "mark", "map")
    texts = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_mark"), F.col("text").alias("_text"))
    found = stored(map_steps(texts, _found, "_id bigint, _mark bigint, kind string, value string", "_text"), "surrogate-found")
    found = found.withColumn("entity", F.unhex(F.sha2(F.concat_ws("\x00", "kind", "value"), 256)))
    counts = stored(found.groupBy("entity").agg(F.first("kind").alias("kind"), F.first("value").alias("value"), F.count(F.lit(1)).alias("size")), "surrogate-values")
    chosen = distinct_surrogates(counts.select("kind", "value"), key)
    chosen = counts.join(chosen, ["kind", "value"]).select("entity", "size", "surrogate")
    pairs = attach(found, chosen, "entity", "size", found.count(), F.struct("_id", "entity"))
    maps = pairs.groupBy(F.col("_id").alias(id_), F.col("_mark").alias(mark)).agg(
        F.collect_set(F.struct("kind", "value", "surrogate")).alias(map_))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(mark))
    joined = keyed.join(maps.hint("merge"), same, "left").drop(own, id_, mark)
    schema = joined.drop(map_).schema.add(count, "long")

    def rewrite(text: str, pairs_: list[dict]) -> tuple[str, int]:
        known = {(p["kind"], p["value"]): p["surrogate"] for p in pairs_}
        out, at, spans = [], 0, entities(text)
        for start, end, kind, value in spans:
            out += [text[at:start], written(known[kind, value], kind, text[start:end])]
            at = end
        return "".join([*out, text[at:]]), len(spans)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [rewrite(t, m) if m else (t, 0) for t, m in zip(batch.column("text").to_pylist(), batch.column(map_).to_pylist())]
        names = [x for x in batch.schema.names if x != map_]
        columns = [pa.array([t for t, _ in done], batch.schema.field(x).type) if x == "text" else batch.column(x) for x in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], names=[*names, count])

    return map_steps(joined, run, schema)
