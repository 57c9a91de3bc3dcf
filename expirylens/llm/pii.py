"""Personal data: format-preserving pseudonyms by keyed Feistel networks."""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from expirylens.llm.common import extended

ROUNDS = 10
# The length of an IBAN in each country that has them.
IBAN_LENGTHS = {k: int(n) for k, n in (x.split(":") for x in """AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22
CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23
IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15
OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22
VG:24 XK:20 YE:30""".split())}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_FIND = re.compile(r"""
    (?P<email>(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@]))
  | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}(?!\w))
  | (?P<ymd>(?<![\w./-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?![\w/-]|\.\d))
  | (?P<dmy>(?<![\w./-])\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}(?![\w/-]|\.\d))
  | (?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))
  | (?P<secret>(?<![A-Za-z])(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}(?P<quote>["']))(?P<value>[^"'\s]{8,})(?P=quote)
  | (?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))
""", re.VERBOSE)
_CARD = re.compile(r"(?P<card>\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))")
# Longer values are permuted in pieces, as the numbers that stand for them grow with them.
PIECE = 200


class Feistel:
    """A keyed permutation of the numbers below any size: an unbalanced network over a grid that holds them,
    walked on until the result is below the size."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, kind: str, size: int, step: int, half: int, below: int) -> int:
        h = hashlib.blake2b(b"%s|%d|%d|%d" % (kind.encode(), size, step, half), key=self.key, digest_size=32).digest()
        return int.from_bytes(h, "big") % below

    def permute(self, value: int, size: int, kind: str) -> int:
        """The image of value (0 <= value < size) under the permutation of this kind and size."""
        if size < 2:
            return value
        a = 1
        while a * a < size:
            a <<= 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for step in range(ROUNDS):
                if step % 2:
                    right = (right + self._round(kind, size, step, left, b)) % b
                else:
                    left = (left + self._round(kind, size, step, right, a)) % a
            value = left * b + right
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it pass the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return str(-total % 10)


def iban_digits(body: str, country: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _fill(pattern: str, new: str) -> str:
    """``new`` put in place of the pattern's letters and digits; separators stay."""
    rest = iter(new)
    return "".join(next(rest) if c.isalnum() else c for c in pattern)


def _permute_digits(f: Feistel, digits: str, kind: str) -> str:
    return f"{f.permute(int(digits), 10 ** len(digits), kind):0{len(digits)}d}" if digits else ""


def _permute_mixed(f: Feistel, text: str, kind: str) -> str:
    """Letters to letters of the same case, digits to digits, the rest as it is; all places as one mixed-radix number.
    Longer texts go in pieces, each by a permutation of its own."""
    if len(text) > PIECE:
        return "".join(_permute_mixed(f, text[k:k + PIECE], f"{kind} {k}" if k else kind) for k in range(0, len(text), PIECE))
    sizes = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    value, size = 0, 1
    for c, n in zip(text, sizes, strict=True):
        if n > 1:
            value = value * n + (int(c) if n == 10 else ord(c.lower()) - 97)
            size *= n
    value = f.permute(value, size, kind)
    out = []
    for c, n in zip(reversed(text), reversed(sizes), strict=True):
        if n == 1:
            out.append(c)
            continue
        value, d = divmod(value, n)
        out.append(str(d) if n == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def _date(f: Feistel, text: str, sep: str, year_first: bool) -> tuple[str, str] | None:
    parts = text.split(sep)
    numbers = [int(p) for p in parts]
    orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]  # day first where both can be
    for order in orders:
        y, m, d = (numbers[k] for k in order)
        if 1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
            day = datetime.date(y, m, d).toordinal() - FIRST_DAY
            new = datetime.date.fromordinal(f.permute(day, LAST_DAY - FIRST_DAY + 1, "date") + FIRST_DAY)
            out = [""] * 3
            for k, v in zip(order, (new.year, new.month, new.day), strict=True):
                out[k] = str(v).zfill(len(parts[k]))
            return "date", sep.join(out)
    return None


def pseudonym(f: Feistel, m: re.Match) -> tuple[str, str] | None:
    """(kind, replacement) of a match, or None if its value is not valid."""
    return _pseudonym(f, _kind(m), m[0], m)


def _kind(m: re.Match) -> str:
    return next(k for k in ("email", "secret", "iban", "ymd", "dmy", "ip", "ssn", "phone", "card") if m[k] is not None)


def _pseudonym(f: Feistel, kind: str, text: str, m: re.Match) -> tuple[str, str] | None:
    digits = "".join(c for c in text if c.isdigit())
    if kind == "email":
        user, _, host = text.rpartition("@")
        name, dot, top = host.rpartition(".")
        return kind, _permute_mixed(f, user.lower(), "user") + "@" + _permute_mixed(f, name.lower(), "host") + dot + top
    if kind == "secret":
        return kind, m["secret"] + _permute_mixed(f, m["value"], "secret") + m["quote"]
    if kind == "iban":
        plain = text.replace(" ", "")
        if IBAN_LENGTHS.get(plain[:2]) != len(plain) or iban_digits(plain[4:], plain[:2]) != plain[2:4]:
            return None
        body = _permute_mixed(f, plain[4:], "iban " + plain[:2])
        return kind, _fill(text, plain[:2] + iban_digits(body, plain[:2]) + body)
    if kind in ("ymd", "dmy"):
        return _date(f, text, m["s1"] or m["s2"], kind == "ymd")
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        new = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip").to_bytes(4, "big")
        return kind, ".".join(map(str, new))
    if kind == "ssn":
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        area = [a for a in range(1, 900) if a != 666]
        value = (area.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        value, serial = divmod(f.permute(value, len(area) * 99 * 9999, "ssn"), 9999)
        a, group = divmod(value, 99)
        return kind, f"{area[a]:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        # the country code stays, the number behind it is permuted
        code = len(re.match(r"\+(\d{1,3})(?=\D)|\+?(\d?)", text)[1] or "") if text[0] == "+" else 0
        return kind, _fill(text, digits[:code] + _permute_digits(f, digits[code:], f"phone {digits[:code]}"))
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = digits[0] + _permute_digits(f, digits[1:-1], "card " + digits[0])
        return kind, _fill(text, body + luhn_digit(body))
    return None


def _shorter(f: Feistel, m: re.Match) -> tuple[tuple[str, str] | None, int]:
    """(kind, replacement) and end of the longest valid value that begins where a match that is not valid does.

    A greedy match takes in digits or capitals that follow a value; values end where a group does.
    """
    kind, text = _kind(m), m[0]
    if kind in ("iban", "phone", "card"):
        for size in range(len(text) - 1, 7, -1):
            if text[size - 1].isalnum() and not text[size].isalnum() and (got := _pseudonym(f, kind, text[:size], m)):
                return got, m.start() + size
    if kind != "card" and (card := _CARD.match(m.string, m.start())):
        if got := _pseudonym(f, "card", card[0], card):
            return got, card.end()
        for size in range(len(card[0]) - 1, 12, -1):
            if card[0][size - 1].isdigit() and not card[0][size].isdigit() and (got := _pseudonym(f, "card", card[0][:size], card)):
                return got, m.start() + size
    return None, m.end()


def replace(f: Feistel, text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text."""
    out, spans, at, size = [], [], 0, 0
    look = 0
    while m := _FIND.search(text, look):
        got, end = pseudonym(f, m), m.end()
        if got is None:
            got, end = _shorter(f, m)
        if got is None:
            look = m.start() + 1
            continue
        out += [text[at:m.start()], got[1]]
        size += m.start() - at
        spans.append((got[0], size, size + len(got[1])))
        size += len(got[1])
        at = look = end
    return "".join(out) + text[at:], spans


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """All rows and columns of ``docs`` with personal data in the text replaced, and ``pii_spans``.

    E-mail addresses, IBANs (length and check digits), calendar dates from 1900 to 2099, IPv4 addresses, social
    security numbers, phone numbers, payment cards (Luhn) and quoted secrets (``token = "..."``) are replaced by values
    of the same format that pass the same test. The key decides a permutation for each kind, so equal values get equal pseudonyms in
    all rows, in whatever punctuation, and different ones never collide. Numbers that
    fail their test stay; where more digits or capitals follow a valid one, the longest valid beginning is replaced.

    ``pii_spans`` lists (kind, start, end) in the new text. A null text stays null and has no spans, an empty one
    stays empty; repeated rows get equal results; a column named ``pii_spans`` is replaced. Nothing is shuffled.
    """
    rows = docs.drop(spans_col)
    at = rows.columns.index(text_col)
    schema = extended(rows.schema, f"`{spans_col}` array<struct<kind:string,start:int,end:int>>")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(at):
                text = text.as_py()
                new, found = (None, []) if text is None else replace(f, text)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*batch.schema.names, spans_col])

    return rows.mapInArrow(run, schema)
