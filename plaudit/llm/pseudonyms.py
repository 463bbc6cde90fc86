"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

A found value is read as a number of its own format (so many digits, so many letters, a date of a
year range), permuted by a Feistel network over just that domain, and written back in the same
format. Equal values give equal pseudonyms in every document and no two values the same one, so
links stay; with the key the permutation can be undone. Check digits and calendar dates are
validated before and hold afterwards.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm import arrays as A

ROUNDS = 8

_MONTHS = {
    name: k
    for k, name in enumerate(
        "January February March April May June July August September October November December".split(), 1
    )
}
_MONTH = "(?:" + "|".join(_MONTHS) + ")"

# The formats looked for, most particular first.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[^\W_][\w.%+-]*@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![\d.-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\d-])",
    "daymonth": r"(?<![\d./-])\d{1,2}([./-])\d{1,2}\1(?:19|20)\d{2}(?![\d-]|[./]\d)",
    "written": rf"(?<![\dA-Za-z])(?:\d{{1,2}}\.? {_MONTH},?|{_MONTH} \d{{1,2}},?) (?:19|20)\d{{2}}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\d-])",
    "intl": r"(?<![\d+])\+\d{8,15}(?!\d)",
    "pairs": r"(?<![\d+])(?:\+\d{1,3}[ .-]?\d|0\d)(?:[ .-]\d{2}){4}(?![\d-])",
    "local": r"(?<![\d.+-])[2-9]\d{2}-\d{4}(?![\d-]|\.\d)",
    "plain": r"(?<![\d.,+-])[2-9]\d{2}[2-9]\d{6}(?![\d-]|[.,]\d)",
}
_KINDS = {name: re.compile(pattern) for name, pattern in PATTERNS.items()}
_FOUND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS.items()).replace(r"([./-])", "(?P<sep>[./-])").replace(r"\1", "(?P=sep)"))
_MAYBE = re.compile(r"@|\d{3}|\d[ .-]\d|[0-9a-fA-F]{32}")
# Countries of bank numbers, for the check of an IBAN.
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_ALPHABETS = (("0123456789", re.compile(r"[0-9]")), ("abcdefghijklmnopqrstuvwxyz", re.compile(r"[a-z]")),
              ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(r"[A-Z]")))


class Feistel:
    """A keyed permutation of 0 .. size - 1.

    Two halves a * b >= size take turns; a result outside the domain goes round again until it is
    inside (cycle walking), which keeps the map one to one.
    """

    def __init__(self, key: bytes, size: int, tweak: bytes = b""):
        self.size = size
        self.key, self.tweak = key, tweak
        self.a = math.isqrt(size - 1) + 1 if size > 1 else 1
        self.b = -(-size // self.a)

    def _round(self, turn: int, value: int, out: int) -> int:
        said = hmac.digest(self.key, b"%b|%d|%d|%d" % (self.tweak, self.size, turn, value), "sha256")
        return int.from_bytes(said, "big") % out

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2 == 0:
                left = (left + sign * self._round(turn, right, self.a)) % self.a
            else:
                right = (right + sign * self._round(turn, left, self.b)) % self.b
        return left * self.b + right

    def permute(self, x: int) -> int:
        x = self._once(x, False)
        while x >= self.size:
            x = self._once(x, False)
        return x

    def undo(self, x: int) -> int:
        x = self._once(x, True)
        while x >= self.size:
            x = self._once(x, True)
        return x


def luhn_digit(body: str) -> str:
    """The check digit that a number's digits before it ask for."""
    total = 0
    for i, ch in enumerate(reversed(body)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> str:
    digits = "".join(str(int(ch, 36)) for ch in rest + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _number(key: bytes, digits: str, tweak: str, back: bool) -> str:
    """Digits to as many digits."""
    if not digits:
        return digits
    feistel = Feistel(key, 10 ** len(digits), tweak.encode())
    return f"{(feistel.undo if back else feistel.permute)(int(digits)):0{len(digits)}d}"


def _refill(shape: str, symbols: str, wanted: re.Pattern) -> str:
    held = iter(symbols)
    return wanted.sub(lambda _: next(held), shape)


def _letters(key: bytes, text: str, tweak: str, back: bool) -> str:
    """Digits and ASCII letters to others of their kinds in the same places."""
    kinds = [next((k for k, (_, kind) in enumerate(_ALPHABETS) if kind.match(ch)), None) for ch in text]
    size, value = 1, 0
    for ch, kind in zip(text, kinds, strict=True):
        if kind is not None:
            alphabet = _ALPHABETS[kind][0]
            size, value = size * len(alphabet), value * len(alphabet) + alphabet.index(ch)
    shape = "".join("-" if k is None else str(k) for k in kinds)
    feistel = Feistel(key, size, f"{tweak}|{shape}".encode())
    value = (feistel.undo if back else feistel.permute)(value)
    out = []
    for ch, kind in zip(reversed(text), reversed(kinds), strict=True):
        if kind is None:
            out.append(ch)
        else:
            alphabet = _ALPHABETS[kind][0]
            value, place = divmod(value, len(alphabet))
            out.append(alphabet[place])
    return "".join(reversed(out))


def _other_date(key: bytes, kind: str, value: str, back: bool) -> str | None:
    """A date in figures with the year last, or with the month's name; one to one in its own form.

    The form is the width of the day and month, the order and the marks between; dates of the same
    form are permuted among each other. Where day and month can be told apart neither way, the first
    number is the month with a slash and the day else.
    """
    if kind == "written":
        month = next(name for name in _MONTHS if name in value)
        figures = re.findall(r"\d+", value)
        day, year, m = int(figures[0]), int(figures[1]), _MONTHS[month]
        shape = re.sub(r"\d", "0", value.replace(month, "M"))
        first = "written"
    else:
        one, two, last = re.split(r"[./-]", value)
        x, y, year = int(one), int(two), int(last)
        first = "month" if (y > 12 if x <= 12 and y > 12 else x <= 12 and "/" in value) else "day"
        m, day = (x, y) if first == "month" else (y, x)
        shape = re.sub(r"\d", "0", value) + first
    try:
        datetime.date(year, m, day)
    except ValueError:
        return None
    domain, index = _dates_of(kind, shape)
    held = Feistel(key, len(domain), f"date{shape}".encode())
    place = index[(year, m, day)]
    year, m, day = domain[(held.undo if back else held.permute)(place)]
    if kind == "written":
        name = next(name for name, k in _MONTHS.items() if k == m)
        said = re.sub("0+", f"{day:0{_width(shape)}d}", shape.replace("0000", "Y"), count=1)
        return said.replace("Y", str(year)).replace("M", name, 1)
    one, two, _ = re.split(r"[./-]", value)
    mark = value[len(one)]
    parts = (m, day) if first == "month" else (day, m)
    return f"{parts[0]:0{len(one)}d}{mark}{parts[1]:0{len(two)}d}{mark}{year}"


def _width(shape: str) -> int:
    return len(re.search("0+", shape.replace("0000", "Y"))[0])


@lru_cache(maxsize=1000)
def _dates_of(kind: str, shape: str) -> tuple[list, dict]:
    """All dates that are written, and read again, in a form."""
    if kind == "written":
        width = _width(shape)

        def fits(m: int, d: int) -> bool:
            return len(str(d)) <= width

    else:
        one, two = (len(x) for x in re.split(r"[./-]", shape)[:2])
        month_first = shape.endswith("month")

        def fits(m: int, d: int) -> bool:
            a, b = (m, d) if month_first else (d, m)
            if len(str(a)) > one or len(str(b)) > two:
                return False
            as_month = b > 12 if a <= 12 and b > 12 else a <= 12 and "/" in shape
            return as_month == month_first

    days = (datetime.date.fromordinal(k) for k in range(_FIRST_DAY, _LAST_DAY + 1))
    domain = [(x.year, x.month, x.day) for x in days if fits(x.month, x.day)]
    return domain, {x: k for k, x in enumerate(domain)}


def _national(key: bytes, kind: str, value: str, code: str, digits: str, back: bool) -> str:
    """A number without separators, of seven digits or of pairs; what its pattern asks of it is kept."""
    any_digit = re.compile(r"\d")
    if kind == "local":
        at = (0,)
    elif kind == "plain":
        at = (0, 3)
    else:
        at = () if code else (0,)
    lead = "".join(digits[k] for k in at) if kind == "pairs" else ""
    size = 8 ** len(at) * 10 ** (len(digits) - len(at)) if kind != "pairs" else 10 ** (len(digits) - len(at))
    number = 0
    for k, ch in enumerate(digits):
        if k in at and kind == "pairs":
            continue
        number = number * (8 if k in at else 10) + int(ch) - (2 if k in at else 0)
    held = Feistel(key, size, f"{kind}{code}{lead}{len(digits)}".encode())
    number = (held.undo if back else held.permute)(number)
    out = []
    for k in reversed(range(len(digits))):
        if k in at and kind == "pairs":
            out.append(digits[k])
            continue
        number, figure = divmod(number, 8 if k in at else 10)
        out.append(str(figure + (2 if k in at else 0)))
    return _refill(value, code + "".join(reversed(out)), any_digit)


@lru_cache(maxsize=100_000)
def pseudonym(key: bytes, kind: str, value: str, back: bool = False) -> str | None:
    """The value's pseudonym in the same format, or None if it is not valid in its format.

    ``back`` undoes it. A valid check digit stays valid, an invalid one invalid in the same way.
    """
    digits = re.sub(r"\D", "", value)
    any_digit = re.compile(r"\d")
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, end = domain.rpartition(".")
        return f"{_letters(key, local, 'email', back)}@{_letters(key, name, 'domain', back)}.{end}"
    if kind == "secret":
        # As hex digits of the same case: letters keep to a-f.
        held = Feistel(key, 16 ** len(value), b"secret" + str(len(value)).encode())
        said = f"{(held.undo if back else held.permute)(int(value, 16)):0{len(value)}x}"
        return said.upper() if value.upper() == value else said
    if kind == "date":
        try:
            day = datetime.date.fromisoformat(value).toordinal()
        except ValueError:
            return None
        held = Feistel(key, _LAST_DAY - _FIRST_DAY + 1, b"date")
        return datetime.date.fromordinal(_FIRST_DAY + (held.undo if back else held.permute)(day - _FIRST_DAY)).isoformat()
    if kind in ("daymonth", "written"):
        return _other_date(key, kind, value, back)
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        number = int.from_bytes(bytes(map(int, parts)), "big")
        held = Feistel(key, 1 << 32, b"ip")
        return ".".join(map(str, (held.undo if back else held.permute)(number).to_bytes(4, "big")))
    if kind == "iban":
        packed = value.replace(" ", "")
        country, check, rest = packed[:2], packed[2:4], packed[4:]
        if _iban_check(country, rest) != check:
            return None
        rest = _letters(key, rest, f"iban{country}", back)
        return _refill(value, country + _iban_check(country, rest) + rest, re.compile(r"[0-9A-Z]"))
    if kind == "card":
        # The body is permuted; the last digit keeps its distance from the right check digit.
        off = (int(digits[-1]) - int(luhn_digit(digits[:-1]))) % 10
        body = _number(key, digits[:-1], "card", back)
        return _refill(value, body + str((int(luhn_digit(body)) + off) % 10), any_digit)
    if kind in ("phone", "intl", "pairs", "local", "plain"):
        # The country code in front stays, all else of the number is permuted.
        front = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)
        code = re.sub(r"\D", "", front[0]) if front else ""
        if kind in ("local", "plain", "pairs"):
            return _national(key, kind, value, code, digits[len(code) :], back)
        return _refill(value, code + _number(key, digits[len(code) :], f"phone{code}", back), any_digit)
    return _refill(value, _number(key, digits, kind, back), any_digit)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text."""
    if not _MAYBE.search(text):
        return text, []
    out, spans, done, length = [], [], 0, 0
    at = 0
    while match := _FOUND.search(text, at):
        kind = next(name for name in PATTERNS if match[name] is not None)
        made = pseudonym(key, kind, match[0], back)
        if made is None:  # other formats from the same place, then all from the next character
            for kind in list(PATTERNS)[list(PATTERNS).index(kind) + 1 :]:
                again = _KINDS[kind].match(text, match.start())
                made = again and pseudonym(key, kind, again[0], back)
                if made is not None:
                    match = again
                    break
            else:
                at = match.start() + 1
                continue
        at = match.end()
        before = text[done : match.start()]
        out += [before, made]
        length += len(before)
        spans.append((kind, length, length + len(made)))
        length += len(made)
        done = match.end()
    out.append(text[done:])
    return "".join(out), spans


def pseudonymise(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False
) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, spans (kind, start, end in the new text).

    Null texts stay null and have no spans, empty ones stay empty. Every text is read whole and by
    itself; repeated rows come out alike. Empty tables and other columns do no harm. ``back`` undoes
    what the same key made, where the pseudonym is found as its format again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in A.blocks(batches):
            texts, spans = [], []
            for text in batch.column("text").to_pylist():
                made, found = (None, []) if text is None else replace(text, key, back)
                texts.append(made)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"]
            )

    schema = "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def key_of(secret: str) -> bytes:
    """A key from a passphrase."""
    return hashlib.sha256(secret.encode()).digest()
