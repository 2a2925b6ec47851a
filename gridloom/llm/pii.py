"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

A value that passes its check (Luhn for card numbers, the calendar for dates, octets for addresses, and so on) is
read as an integer in the domain of its format, permuted by a balanced Feistel network under a key, and written back
in the same format: grouping, separators, letter case and check digits stay right. What is permuted is the value's
normal form (a phone number's country code and digits, a date's day, a name without case), written back in the shape
that was found: equal values get equal pseudonyms in every document and spelling, so records stay linked, and the
holder of the key can go back. Values that fail their check are left alone.

The scan's patterns are of bounded length, so its time follows the length of a text.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import own_columns, sealed, table, unsealed

#: For tests and benchmarks. Production passes a secret of its own.
DEMONSTRATION_KEY = b"gridloom demonstration key"
ROUNDS = 10
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date", "secret")


# --- the permutation ------------------------------------------------------------------------------------------------


def _half(key: bytes, tweak: bytes, turn: int, value: int, bits: int) -> int:
    size = (bits + 7) // 8
    digest = hashlib.blake2b(turn.to_bytes(1, "big") + tweak + b"\0" + value.to_bytes(size, "big"), key=key[:64], digest_size=min(64, max(16, size))).digest()
    while len(digest) < size:
        digest += hashlib.blake2b(digest, key=key[:64]).digest()
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def permute(value: int, domain: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(domain); walks on while the network leaves the domain."""
    if domain < 2:
        return value
    bits = max(1, ((domain - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        left, right = value >> bits, value & mask
        if back:
            for turn in reversed(range(ROUNDS)):
                left, right = right ^ _half(key, tweak, turn, left, bits), left
        else:
            for turn in range(ROUNDS):
                left, right = right, left ^ _half(key, tweak, turn, right, bits)
        value = left << bits | right
        if value < domain:
            return value


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PLACE = {c: (i, j) for i, alphabet in enumerate(_CLASSES) for j, c in enumerate(alphabet)}


def permute_text(text: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    """Permute ASCII digits and letters within their class; other characters stay in place."""
    value, domain = 0, 1
    for c in text:
        if c in _PLACE:
            kind, at = _PLACE[c]
            value = value * len(_CLASSES[kind]) + at
            domain *= len(_CLASSES[kind])
    value = permute(value, domain, key, tweak, back)
    out = []
    for c in reversed(text):
        if c in _PLACE:
            alphabet = _CLASSES[_PLACE[c][0]]
            value, at = divmod(value, len(alphabet))
            c = alphabet[at]
        out.append(c)
    return "".join(reversed(out))


def permute_digits(text: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    """Permute the digits of a text as one number; all else stays in place."""
    digits = [c for c in text if c.isdigit()]
    fresh = iter(str(permute(int("".join(digits)), 10 ** len(digits), key, tweak, back)).zfill(len(digits)))
    return "".join(next(fresh) if c.isdigit() else c for c in text)


# --- checks and pseudonyms by kind ----------------------------------------------------------------------------------


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(found: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = permute_digits(digits[:-1], key, b"card", back)
    fresh = iter(body + luhn_digit(body))
    return "".join(next(fresh) if c.isdigit() else c for c in found)


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(found: str, key: bytes, back: bool) -> str | None:
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or (98 - _iban_rest(plain[:2], plain[4:])) != int(plain[2:4]):
        return None
    body = permute_text(plain[4:], key, b"iban" + plain[:2].encode(), back)
    fresh = iter(f"{plain[:2]}{98 - _iban_rest(plain[:2], body):02d}{body}")
    return "".join(c if c == " " else next(fresh) for c in found)


def _email(found: str, key: bytes, back: bool) -> str | None:
    local, _, host = found.rpartition("@")
    fresh = permute_text(local.lower(), key, b"email" + host.lower().encode(), back)
    return "".join(x.upper() if c.isupper() else x for c, x in zip(local, fresh)) + "@" + host


# Country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _phone(found: str, key: bytes, back: bool) -> str | None:
    """The country code stays, the digits after it are permuted; a number without one is North American."""
    digits = re.sub(r"\D", "", found)
    if not 8 <= len(digits) <= 15:
        return None
    lead = next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRY_CODES), digits[:3]) if found[0] == "+" else ""
    body = permute_digits(digits[len(lead) :], key, b"phone" + (lead or "1").encode(), back)
    fresh = iter(lead + body)
    return "".join(next(fresh) if c.isdigit() else c for c in found)


def _ssn(found: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, found.split("-"))

    def good(a: int, g: int, s: int) -> bool:
        return a not in (0, 666) and a < 900 and g > 0 and s > 0

    if not good(area, group, serial):
        return None
    value = area * 10**6 + group * 10**4 + serial
    while True:  # walks on to the next number that can be issued
        value = permute(value, 9 * 10**8, key, b"ssn", back)
        if good(value // 10**6, value // 10**4 % 100, value % 10**4):
            return f"{value // 10**6:03d}-{value // 10**4 % 100:02d}-{value % 10**4:04d}"


def _ip(found: str, key: bytes, back: bool) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255:
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _day_class(d: datetime.date) -> tuple[int, bool]:
    """What a date's spelling shows of it: how wide day and month are, and whether a month can't be meant."""
    return (0 if d.day < 10 else 1 if d.day < 13 else 2), d.month > 9


@lru_cache(maxsize=1)
def _days() -> dict[tuple[int, bool], list[int]]:
    """The days of 1900 to 2099, by class. A day is permuted within its class, so that every spelling of it keeps its
    widths and its order of day and month, and all spellings of a day get the same one."""
    out: dict[tuple[int, bool], list[int]] = {}
    for at in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()):
        out.setdefault(_day_class(datetime.date.fromordinal(at)), []).append(at)
    return out


def _date(found: str, key: bytes, back: bool) -> str | None:
    mark = next(c for c in found if not c.isdigit())
    parts = found.split(mark)
    iso = len(parts[0]) == 4
    year, month, day = (int(parts[0]), int(parts[1]), int(parts[2])) if iso else (int(parts[2]), int(parts[1]), int(parts[0]))
    american = not iso and month > 12 >= day  # written month first
    if american:
        month, day = day, month
    try:
        d = datetime.date(year, month, day)
    except ValueError:
        return None
    if not 1900 <= year < 2100:
        return None
    kind = _day_class(d)
    days = _days()[kind]
    at = permute(bisect.bisect_left(days, d.toordinal()), len(days), key, b"date%d%d" % kind, back)
    d = datetime.date.fromordinal(days[at])
    ordered = (d.year, d.month, d.day) if iso else (d.month, d.day, d.year) if american else (d.day, d.month, d.year)
    return mark.join(str(x).zfill(len(p)) for x, p in zip(ordered, parts))


def _secret(found: str, key: bytes, back: bool) -> str | None:
    """Hexadecimal keys of one case are permuted as one number in base 16; of keys with a known beginning that
    beginning stays and the rest is permuted within digits and letters of each case. Both must have a digit."""
    if not re.search(r"\d", found):
        return None
    lead = PREFIX.match(found)
    if lead:
        return lead.group() + permute_text(found[lead.end() :], key, b"secret" + lead.group().encode(), back)
    if not re.search(r"[A-Fa-f]", found) or found not in (found.lower(), found.upper()):
        return None
    fresh = format(permute(int(found, 16), 16 ** len(found), key, b"secret", back), "x").zfill(len(found))
    return fresh.upper() if found != found.lower() else fresh


# How keys of well-known services begin.
PREFIX = re.compile(r"AKIA|ASIA|AIza|sk-(?:proj-|ant-)?|[sr]k_(?:live|test)_|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|hf_|npm_|SG\.")
# The formats looked for, the first that fits counts. Each ends and begins at a border of letters and digits.
PATTERN = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63})"
    r"|(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<secret>[0-9a-fA-F]{32,64}|A[KS]IA[0-9A-Z]{16}|(?:" + PREFIX.pattern + r")[0-9A-Za-z_-]{20,200})"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<card>[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<gap_2>[ -])[0-9]{6}(?P=gap_2)[0-9]{5})"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})"
    r")(?![A-Za-z0-9])"
)
HANDLERS: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "secret": _secret}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, found: str, key: bytes, back: bool = False) -> str | None:
    return HANDLERS[kind](found, key, back)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its valid values permuted, and (kind, start, length) of each by code points; lengths may change
    for addresses alone, so places are those in the new text."""
    out, spans, at, size = [], [], 0, 0
    for m in PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup in HANDLERS else next(k for k in KINDS if m.group(k))
        fresh = pseudonym(kind, m.group(), key, back)
        if fresh is None:
            continue
        out += [text[at : m.start()], fresh]
        size += m.start() - at
        spans.append((kind, size, len(fresh)))
        size += len(fresh)
        at = m.end()
    return ("".join(out) + text[at:], spans) if spans else (text, spans)


def pseudonymise(documents: DataFrame, key: bytes = DEMONSTRATION_KEY, keep: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """The columns of ``keep``, the new text, how many values were found by kind, and their spans in the new text.

    Null text stays null with nothing found; repeated rows are handled one by one, very long texts in whole.
    """
    fields = [documents.schema[k] for k in keep]
    counts = [f"n_{k}" for k in KINDS]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["_text string"] + [f"{c} int" for c in counts] + ["spans array<struct<kind:string,start:int,length:int>>"])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            # nearly every text has no digit or @: those pass as they are
            touched = pc.fill_null(pc.match_substring_regex(text, "[0-9@]"), False).to_numpy(zero_copy_only=False)
            fresh, found = [], [[] for _ in range(len(text))]
            number = np.zeros((len(KINDS), len(text)), np.int32)
            for i in np.flatnonzero(touched).tolist():
                new, spans = replace(text[i].as_py(), key, back)
                fresh.append(new)
                found[i] = [{"kind": k, "start": a, "length": n} for k, a, n in spans]
                for k, _, _ in spans:
                    number[KINDS.index(k), i] += 1
            new_text = pc.replace_with_mask(text, pa.array(touched), pa.array(fresh, text.type)) if fresh else text
            own = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*own, new_text, *(pa.array(x) for x in number), pa.array(found, span_type)], names=[*keep, "_text", *counts, "spans"])

    return own_columns(documents, *dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with pseudonyms in its text, counts by kind and the places; null texts stay null."""
    return pseudonymise(table(spark, sf_dir, "documents")).withColumnRenamed("_text", "text")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts with pseudonyms; the length column follows where there is one. Null texts stay null, and
    extra columns of any name stay as they are."""
    own = sealed(docs, "text")
    found = pseudonymise(own, keep=tuple(own.columns))
    fresh = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        place = f"_own_{docs.columns.index('n_chars')}"
        fresh[place] = F.when(F.size("spans") > 0, F.length("_text")).otherwise(F.col(place)).cast(docs.schema["n_chars"].dataType)
    return unsealed(found.withColumns(fresh), docs, "text")
