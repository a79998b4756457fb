"""PII: detected entities receive keyed, type-consistent surrogates (operator 5).

Semantics. Entities are e-mail addresses, payment cards (Luhn), IBANs (mod 97), IPv4 addresses, phone numbers, US social
security numbers, access keys (``AKIA...``) and person names (after a form of address or an introduction). Where matches
overlap, the kind listed first in ``KINDS`` wins, then the leftmost. Each is replaced by a surrogate of the same kind and
format: digits become digits in place, letters keep case and script (Latin, Greek, Cyrillic; vowels stay vowels), checks
are recomputed, a listed given name becomes another of the same gender and script, a form of address stays. The same
entity has the same surrogate in every document (its value is compared without case and, for numbers, without
punctuation); different entities have different ones, and no surrogate is a value that occurs in the corpus.
Null texts stay null, empty texts empty; rows repeat as they come; null ids pass; an empty table gives an empty result;
extra columns pass through.

Method. A surrogate is a keyed permutation (an unbalanced Feistel network on mixed-radix numbers, so distinctness needs no
table) of the entity's free characters. Distinct entities of the corpus are aggregated, and a check finds surrogates that
equal one another or a value of the corpus; those entities move to their next attempt until none is left. From attempt
``MAX_ATTEMPTS`` on, formats without a fixed length grow, more so with every ``MAX_ATTEMPTS`` attempts: a listed given name
becomes several of the same gender and script joined by hyphens, other names and the local parts of addresses get more
letters. Numbers and keys cannot grow; where a corpus holds so much of such a format that no free value is found in
``LAST_ATTEMPT`` attempts, the query fails rather than give a value twice.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize

KEY = b"skysift-surrogates-1"
#: Attempts within a format before it grows, and the attempt at which formats that cannot grow give up.
MAX_ATTEMPTS, LAST_ATTEMPT = 12, 240
#: Up to so many exceptions to the first attempt are broadcast; more are joined by a shuffle.
MAX_EXCEPTIONS = 500_000

#: Given names by gender and script; surrogates are drawn from the same list.
GIVEN = {
    ("f", "latin"): "Alice Amelia Ana Anna Beatriz Camille Carla Carmen Chloe Clara Claire Elena Elise Emily Emma Eva Hannah Helga Ines Ingrid Isabel Julia Karin Laura Lena Lucia Manon Maria Marie Marta Mary Nadine Olivia Paula Petra Rosa Sabine Sofia Sophie Susan Ursula Zoe".split(),
    ("m", "latin"): "Adam Alain Alejandro Andreas Antoine Antonio Carlos Charles Daniel David Diego Dieter Fernando Frank Georg Hans Henri Hugo Jack James Javier Jean John Jorge Jose Juan Klaus Louis Luc Luis Marc Markus Martin Michel Miguel Oliver Pablo Paul Peter Pierre Ralf Robert Stefan Thomas Werner William".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("f", "greek"): "Αθηνά Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(),
}
_PLACE = {name.lower(): (key, k) for key, names in GIVEN.items() for k, name in enumerate(names)}

_LETTER = r"[^\W\d_]"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr)\.?"
_INTRO = r"(?:[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут)"
_NAME = rf"[A-ZÀ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ]{_LETTER}+(?:-{_LETTER}+)?"
#: (kind, pattern, text that must occur for the pattern to be tried)
KINDS = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.A), "@"),
    ("key", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), "AKIA"),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), None),
    ("card", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"), None),
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"), None),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "-"),
    ("phone", re.compile(r"(?<![\w+])(?<!\d[ .-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?![\w-])(?![ .]\d)"), None),
    ("name", re.compile(rf"(?<!\w)(?:{_TITLE}|{_INTRO})\s+({_NAME}(?: {_NAME})?)"), None),
]
_ANY_DIGIT = re.compile(r"\d")
_NAME_HINT = re.compile(rf"(?:{_TITLE}|{_INTRO})\s")


def luhn_digit(digits: str) -> str:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(ch, 36)) for ch in body + country + "00"))
    return f"{98 - number % 97:02d}"


def _valid(kind: str, raw: str) -> bool:
    digits = re.sub(r"\D", "", raw)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1]
    if kind == "iban":
        flat = raw.replace(" ", "")
        return 15 <= len(flat) <= 34 and iban_check(flat[:2], flat[4:]) == flat[2:4]
    if kind == "ip":
        return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in raw.split("."))
    if kind == "phone":
        return 7 <= len(digits) <= 15 and ("+" in raw or "(" in raw or len(digits) >= 10)
    return True


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, not overlapping."""
    out: list[tuple[int, int, str]] = []
    has_digit = bool(_ANY_DIGIT.search(text))
    for kind, pattern, needs in KINDS:
        if (needs and needs not in text) or (kind in ("iban", "card", "ip", "ssn", "phone") and not has_digit) or (kind == "name" and not _NAME_HINT.search(text)):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "name" else m.span()
            if _valid(kind, text[a:b]) and all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, kind))
    return sorted(out)


def normal(kind: str, raw: str) -> str:
    """The value by which two mentions are the same entity."""
    if kind in ("card", "ssn", "phone"):
        return ("+" if raw.startswith("+") else "") + re.sub(r"\D", "", raw)
    return raw.replace(" ", "") if kind == "iban" else raw if kind in ("key", "ip") else raw.lower()


_VOWELS = {"latin": "aeiou", "greek": "αεηιου", "cyrillic": "аеиоуы"}
_OTHERS = {"latin": "bcdfghjklmnpqrstvwxyz", "greek": "βγδζθκλμνξπρστφχψ", "cyrillic": "бвгджзклмнпрстфхцчшщ"}
_ALPHABETS = ["0123456789", *_VOWELS.values(), *_OTHERS.values()]
_CLASS = {ch: a for a in _ALPHABETS for ch in a}


def _permute(values: list[int], radix: list[int], label: str) -> list[int]:
    """A keyed permutation of mixed-radix numbers, the same for equal ``label`` and radices."""
    half = len(values) // 2
    sizes = [1, 1]
    for k, r in enumerate(radix):
        sizes[k >= half] *= r
    pair = [0, 0]
    for k, (v, r) in enumerate(zip(values, radix, strict=True)):
        pair[k >= half] = pair[k >= half] * r + v
    for turn in range(8):
        side, other = turn % 2, 1 - turn % 2
        if sizes[side] > 1:
            seed = hmac.new(KEY, f"{label}|{radix}|{turn}|{pair[other]}".encode(), hashlib.sha256).digest()
            pair[side] = (pair[side] + int.from_bytes(hashlib.shake_256(seed).digest(sizes[side].bit_length() // 8 + 9), "big")) % sizes[side]
    out = []
    for side, part in ((1, radix[half:]), (0, radix[:half])):
        n = pair[side]
        for r in reversed(part):
            out.append(n % r)
            n //= r
    return out[::-1]


def _chars(raw: str, label: str, free=None) -> str:
    """Permute the characters of known alphabets in place (or those that ``free`` allows); case and the rest stay."""
    spots = [(k, _CLASS[ch.lower()]) for k, ch in enumerate(raw) if ch.lower() in _CLASS and (free is None or free(k))]
    shape = "".join(a[0] for _, a in spots) + "|" + "".join("\0" if _CLASS.get(ch.lower()) and (free is None or free(k)) else ch for k, ch in enumerate(raw.lower()))
    new = _permute([a.index(raw[k].lower()) for k, a in spots], [len(a) for _, a in spots], f"{label}|{shape}")
    out = list(raw)
    for (k, a), v in zip(spots, new, strict=True):
        out[k] = a[v].upper() if raw[k].isupper() else a[v]
    return "".join(out)


_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _code(raw: str, label: str) -> str:
    """Capital letters to capital letters, digits to digits."""
    kinds = ["0123456789" if ch.isdigit() else _BASE36[10:] for ch in raw]
    new = _permute([a.index(ch) for a, ch in zip(kinds, raw, strict=True)], [len(a) for a in kinds], f"{label}|{''.join(a[0] for a in kinds)}")
    return "".join(a[v] for a, v in zip(kinds, new, strict=True))


def _drawn(seed: str, sizes: list[int]) -> list[int]:
    """A keyed number below each size."""
    digest = hashlib.shake_256(hmac.new(KEY, seed.encode(), hashlib.sha256).digest()).digest(8 * len(sizes))
    return [int.from_bytes(digest[8 * k : 8 * k + 8], "big") % n for k, n in enumerate(sizes)]


def _longer(word: str, label: str, grow: int) -> str:
    """``word`` permuted, letters of no known alphabet replaced, and ``grow`` pairs of letters of its script behind it."""
    script = next((s for ch in word.lower() for s in _VOWELS if ch in _VOWELS[s] or ch in _OTHERS[s]), None)
    if script is None:
        code = next((ord(ch) for ch in word if ch.isalpha()), 0)
        script = "greek" if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else "cyrillic" if 0x400 <= code < 0x530 else "latin"
    alphabets = [_OTHERS[script], _VOWELS[script]]
    strange = [k for k, ch in enumerate(word) if ch.isalpha() and ch.lower() not in _CLASS]
    fill = [alphabets[k % 2] for k in range(len(strange) + 2 * grow)]
    letters = [a[n] for a, n in zip(fill, _drawn(f"{label}|{word}", [len(a) for a in fill]), strict=True)]
    out = list(_chars(word, label))
    for k, ch in zip(strange, letters, strict=False):
        out[k] = ch
    return "".join([*out, *letters[len(strange) :]])


def _name(value: str, label: str, grow: int = 0) -> str:
    out = []
    for word in value.split(" "):
        found = _PLACE.get(word)
        if found and grow:
            # Never the name itself among its parts.
            names = [n for n in GIVEN[found[0]] if n.lower() != word]
            out.append("-".join(names[k].lower() for k in _drawn(f"{label}|{word}", [len(names)] * (grow + 1))))
        elif found:
            names = GIVEN[found[0]]
            out.append(names[_permute([found[1]], [len(names)], f"{label}|{found[0]}")[0]].lower())
        else:
            out.append(_longer(word, label, grow) if grow else _chars(word, label))
    return " ".join(out)


def surrogate(kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a normal value."""
    label, grow = f"{kind}|{attempt}", attempt // MAX_ATTEMPTS
    if kind == "email":
        local, _, domain = value.partition("@")
        head, _, tail = domain.rpartition(".")
        return f"{_longer(local, label, grow) if grow else _chars(local, label)}@{_chars(head, label + '|domain')}.{tail}"
    if kind == "card":
        new = value[0] + _chars(value[1:-1], label + value[0] + str(len(value)))
        return new + luhn_digit(new)
    if kind == "iban":
        body = _code(value[4:], label + value[:2])
        return value[:2] + iban_check(value[:2], body) + body
    if kind == "key":
        return "AKIA" + _code(value[4:], label)
    if kind == "ip":
        return ".".join(map(str, _permute([int(p) for p in value.split(".")], [256] * 4, label)))
    if kind == "phone":
        head = 2 if value.startswith("+") else 0
        return value[:head] + _chars(value[head:], label)
    return _name(value, label, grow) if kind == "name" else _chars(value, label)


def render(kind: str, raw: str, value: str) -> str:
    """A surrogate value in the format (punctuation, spaces, case) of the text it replaces."""
    if kind in ("card", "ssn", "phone", "iban"):
        take = iter(value.replace("+", "") if kind != "iban" else value)
        return "".join(next(take) if ch.isalnum() else ch for ch in raw)
    if kind == "name":
        words = []
        for old, new in zip(raw.split(" "), value.split(" "), strict=True):
            words.append(new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new)
        return " ".join("-".join(p[:1].upper() + p[1:] for p in w.split("-")) if "-" in w else w for w in words)
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(raw, value, strict=True)) if len(raw) == len(value) else value
    return value


def replace_entities(text: str, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for a, b, kind in find_entities(text):
        value = normal(kind, text[a:b])
        out += [text[at:a], render(kind, text[a:b], surrogate(kind, value, attempts.get((kind, value), 0)))]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = {(kind, normal(kind, t[a:e])) for t in b.column(0).to_pylist() if t for a, e, kind in find_entities(t)}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(*r) for r in rows], pa.string())], names=["kind", "value", "attempt", "surrogate"])


def entity_attempts(docs: DataFrame) -> DataFrame:
    """(kind, value, attempt) of the entities that need an attempt after the first."""
    plain = docs.select(F.col("text").cast("string").alias("text"))
    every = materialize(plain.mapInArrow(_detect, "kind string, value string").distinct(), "entities")
    now = every.withColumn("attempt", F.lit(0))
    while True:
        given = materialize(now.mapInArrow(_assign, "kind string, value string, attempt int, surrogate string"), "surrogates")
        twice = given.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("keep"), F.count("*").alias("n")).filter("n > 1")
        clash = given.join(twice, ["kind", "surrogate"]).filter(F.col("value") != F.col("keep.value")).select("kind", "value")
        real = given.join(every.withColumnRenamed("value", "surrogate"), ["kind", "surrogate"], "left_semi").select("kind", "value")
        bad = materialize(clash.unionByName(real).distinct().withColumn("bad", F.lit(True)), "clashes")
        if bad.isEmpty():
            break
        now = given.join(bad, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.when(F.col("bad"), 1).otherwise(0)).alias("attempt"))
        if not now.filter(F.col("attempt") >= LAST_ATTEMPT).isEmpty():
            raise RuntimeError("the corpus holds so many values of one format that surrogates find no free value in it")
    return given.filter("attempt > 0").select("kind", "value", "attempt")


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = {(key, kind, normal(kind, t[a:e])) for key, t in dict(zip(*(b.column(k).to_pylist() for k in range(2)), strict=True)).items() for a, e, kind in find_entities(t)}
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["_text_key", "kind", "value"])


def _with_attempts(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """``docs`` with ``_attempts``, the exceptions that occur in its text; texts are met by the digest of what they say."""
    key = F.sha2("text", 256)
    found = docs.filter("text is not null").select(key.alias("_text_key"), "text").mapInArrow(_mentions, "_text_key string, kind string, value string")
    own = found.join(odd.hint("shuffle_merge"), ["kind", "value"]).groupBy("_text_key").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("_attempts"))
    return docs.join(own.hint("shuffle_merge"), key == F.col("_text_key"), "left").drop("_text_key")


def replace_pii(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``counts``, also n_entities and kinds."""
    attempts = entity_attempts(docs)
    odd = attempts.limit(MAX_EXCEPTIONS + 1).collect()
    many = len(odd) > MAX_EXCEPTIONS
    shared = docs.sparkSession.sparkContext.broadcast({} if many else {(r["kind"], r["value"]): r["attempt"] for r in odd})
    docs = docs.withColumn("text", F.col("text").cast("string"))
    place = docs.columns.index("text")
    schema = StructType(list(docs.schema.fields))
    if counts:
        schema = schema.add("n_entities", "long").add("kinds", "string")
    if many:
        docs = _with_attempts(docs, attempts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shared.value] * b.num_rows
            if many:
                own = [{(x["kind"], x["value"]): x["attempt"] for x in found or ()} for found in b.column(b.num_columns - 1).to_pylist()]
                b = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])
            done = [(None, []) if t is None else replace_entities(t, o) for t, o in zip(b.column(place).to_pylist(), own, strict=True)]
            cols, names = list(b.columns), list(b.schema.names)
            cols[place] = pa.array([t for t, _ in done], pa.string())
            if counts:
                cols += [pa.array([len(k) for _, k in done], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in done], pa.string())]
                names += ["n_entities", "kinds"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
