"""Format-preserving pseudonyms: validated personal values are permuted by a keyed Feistel network within their own format.

Equal values get equal pseudonyms in every document, different values different ones, and the key's owner can reverse them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline.llm.shared import send

ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

# Length of the national part of an IBAN by country of the registry (letters and digits after the check digits).
IBAN_LENGTHS = {
    "AD": 20, "AE": 19, "AL": 24, "AT": 16, "AZ": 24, "BA": 16, "BE": 12, "BG": 18, "BH": 18, "BI": 23, "BR": 25, "BY": 24, "CH": 17,
    "CR": 18, "CY": 24, "CZ": 20, "DE": 18, "DJ": 23, "DK": 14, "DO": 24, "EE": 16, "EG": 25, "ES": 20, "FI": 14, "FK": 14, "FO": 14,
    "FR": 23, "GB": 18, "GE": 18, "GI": 19, "GL": 14, "GR": 23, "GT": 24, "HN": 24, "HR": 17, "HU": 24, "IE": 18, "IL": 19, "IQ": 19,
    "IS": 22, "IT": 23, "JO": 26, "KW": 26, "KZ": 16, "LB": 24, "LC": 28, "LI": 17, "LT": 16, "LU": 16, "LV": 17, "LY": 21, "MC": 23,
    "MD": 20, "ME": 18, "MK": 15, "MN": 16, "MR": 23, "MT": 27, "MU": 26, "NI": 24, "NL": 14, "NO": 11, "OM": 19, "PK": 20, "PL": 24,
    "PS": 25, "PT": 21, "QA": 25, "RO": 20, "RS": 18, "RU": 29, "SA": 20, "SC": 27, "SD": 14, "SE": 20, "SI": 15, "SK": 20, "SM": 23,
    "SO": 19, "ST": 21, "SV": 24, "TL": 19, "TN": 20, "TR": 22, "UA": 25, "VA": 18, "VG": 20, "XK": 16, "YE": 26,
}


# Names of the months, beginnings of access keys, country codes of two digits.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
KEY_MARKS = r"AKIA|sk-|gh[opsu]_|glpat-|xox[abp]-"
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


class Permutation:
    """Keyed permutations of [0, size): a Feistel network over two unequal halves, walked until it is back in the range."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.back = back

    def _turn(self, tweak: str, size: int, n: int, half: int) -> int:
        data = f"{tweak}|{size}|{n}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def __call__(self, tweak: str, value: int, size: int) -> int:
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for n in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
                if n % 2:
                    move = self._turn(tweak, size, n, left) % b
                    right = (right - move if self.back else right + move) % b
                else:
                    move = self._turn(tweak, size, n, right) % a
                    left = (left - move if self.back else left + move) % a
            value = left * b + right
            if value < size:
                return value


def _mixed(permute: Permutation, tweak: str, places: list[tuple[str, str]]) -> str:
    """Permutes a string as one number; each place has its alphabet and its character."""
    value, size = 0, 1
    for alphabet, char in places:
        value, size = value * len(alphabet) + alphabet.index(char), size * len(alphabet)
    value = permute(tweak, value, size) if size > 1 else 0
    out = []
    for alphabet, _ in reversed(places):
        value, digit = divmod(value, len(alphabet))
        out.append(alphabet[digit])
    return "".join(reversed(out))


DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _like(permute: Permutation, tweak: str, text: str, fixed: str = "") -> str:
    """Permutes letters and digits within their kind; other characters stay. The shape is part of the tweak."""
    alphabets = [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c for c in text]
    shape = "".join({DIGITS: "9", LOWER: "a", UPPER: "A"}.get(x, x) for x in alphabets)
    return _mixed(permute, f"{tweak}|{fixed}|{shape}", list(zip(alphabets, text)))


def _put(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced in turn."""
    turn = iter(digits)
    return "".join(next(turn) if c in DIGITS else c for c in shape)


def luhn(payload: str) -> str:
    """The check digit behind a payload."""
    doubled = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(payload))]
    return str(-sum(x // 10 + x % 10 for x in doubled) % 10)


def card_length(found: str) -> int:
    """Length of the shortest part up to a separator or the end that is a card number: 13 digits or more, not all equal, with a right
    check digit; 0 if there is none. What stands behind it (an expiry date, a security code) has no say in it."""
    for end in [i for i, c in enumerate(found) if c in " -"] + [len(found)]:
        digits = re.sub(r"\D", "", found[:end])
        if len(digits) >= 13 and len(set(digits)) > 1 and luhn(digits[:-1]) == digits[-1]:
            return end
    return 0


def card(permute: Permutation, found: str) -> str | None:
    """13 to 19 digits with a right check digit: all but the first (the network) change, the check digit is made anew."""
    if card_length(found) != len(found):
        return None
    digits = re.sub(r"\D", "", found)
    head, middle, new = digits[0], digits[1:-1], ""
    # Walked until it is read back with the same length.
    while card_length(new) != len(found):
        middle = _mixed(permute, f"card|{head}", [(DIGITS, c) for c in middle])
        new = _put(found, head + middle + luhn(head + middle))
    return new


def phone(permute: Permutation, found: str) -> str | None:
    """North American numbers: area and exchange begin with 2 to 9 before and after; other numbers need the country code."""
    digits = re.sub(r"\D", "", found)
    head, number = digits[:-10], digits[-10:]
    if number[0] not in "01" and number[3] not in "01":
        number = _mixed(permute, "phone", [("23456789" if i in (0, 3) else DIGITS, c) for i, c in enumerate(number)])
    elif head:
        number = _mixed(permute, "other phone", [(DIGITS, c) for c in number])
        while number[0] not in "01" and number[3] not in "01":
            number = _mixed(permute, "other phone", [(DIGITS, c) for c in number])
    else:
        return None
    return _put(found, head + number)


def social(permute: Permutation, found: str) -> str | None:
    """US social security numbers without area 000, 666 or 900 and more, group 00 or serial 0000."""
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute("social", value, 898 * 99 * 9999), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def address(permute: Permutation, found: str) -> str | None:
    """IPv4 addresses whose first part is neither 0 nor 127 (this host)."""
    parts = [int(x) for x in found.split(".")]
    if any(str(n) != x for n, x in zip(parts, found.split("."))) or max(parts) > 255 or parts[0] in (0, 127):
        return None
    value = parts[0] - 1 - (parts[0] > 127)
    for x in parts[1:]:
        value = value * 256 + x
    value = permute("address", value, 254 << 24)
    first = (value >> 24) + 1
    return ".".join(map(str, (first + (first >= 127), value >> 16 & 255, value >> 8 & 255, value & 255)))


def _date(parts: tuple[int, int, int]) -> dt.date | None:
    try:
        day = dt.date(*parts)
    except ValueError:
        return None
    return day if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


class _Days:
    """Days whose number in the month is over 12 (late), or the others, in order.

    Both are permuted apart: a late day stays one, so a date that can only be read month first stays so, and a day has one
    pseudonym, however it is written.
    """

    def __init__(self, late: bool) -> None:
        self.late = late
        self.days: list[int] = []

    def get(self) -> list[int]:
        if not self.days:
            self.days = [x for x in range(FIRST_DAY, LAST_DAY + 1) if (dt.date.fromordinal(x).day > 12) == self.late]
        return self.days


LATE_DAYS, EARLY_DAYS = _Days(True), _Days(False)


def date(permute: Permutation, found: str) -> str | None:
    """Dates of 1900 to 2099: year first, or day first, or month first where only that can be meant, or with the month's name.

    A day gets the same pseudonym in every spelling; it is written in the one found. The name of May is the same in full and
    shortened, so a shortened month comes back in full where its pseudonym falls in May.
    """
    named = re.fullmatch(r"(?:(\d+) ([A-Z][a-z]+)|([A-Z][a-z]+) (\d+))(,?) (\d+)", found)
    if named:
        number, month = named[1] or named[4], named[2] or named[3]
        names = MONTHS if month in MONTHS else [m[:3] for m in MONTHS]
        day = _date((int(named[6]), names.index(month) + 1, int(number)))
    else:
        a, mark, b, c = re.match(r"(\d+)([-/.])(\d+)[-/.](\d+)", found).groups()
        month_first = False
        day = _date((int(a), int(b), int(c)) if len(a) == 4 else (int(c), int(b), int(a)))
        if not day and len(a) == 2:
            month_first = True
            day = _date((int(c), int(a), int(b)))
    if not day:
        return None
    days = (LATE_DAYS if day.day > 12 else EARLY_DAYS).get()
    moved = dt.date.fromordinal(days[permute("late" if day.day > 12 else "early", bisect_left(days, day.toordinal()), len(days))])
    if named:
        month = names[moved.month - 1]
        return f"{moved.day} {month}{named[5]} {moved:%Y}" if named[1] else f"{month} {moved.day}{named[5]} {moved:%Y}"
    order = ("%Y", "%m", "%d") if len(a) == 4 else ("%m", "%d", "%Y") if month_first else ("%d", "%m", "%Y")
    return mark.join(moved.strftime(x) for x in order)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban_length(found: str) -> int:
    """Length of the part that has as many letters and digits as the country's IBANs, if it ends with a group; else 0."""
    places = [i for i, c in enumerate(found) if c != " "]
    n = 4 + IBAN_LENGTHS.get(found[:2], len(found))
    end = places[n - 1] + 1 if n <= len(places) else 0
    return end if found[end : end + 1] in ("", " ") else 0


def iban(permute: Permutation, found: str) -> str | None:
    """IBANs of known length with right check digits: the national part changes within its kinds, the check digits follow."""
    flat = found.replace(" ", "")
    country, national = flat[:2], flat[4:]
    if IBAN_LENGTHS.get(country) != len(national) or _iban_number(national + country + flat[2:4]) % 97 != 1:
        return None
    changed = _like(permute, "iban", national, country)
    turn = iter(f"{country}{98 - _iban_number(changed + country + '00') % 97:02d}{changed}")
    return "".join(c if c == " " else next(turn) for c in found)


def email(permute: Permutation, found: str) -> str | None:
    """Local part and host change within their kinds, one by one, so hosts stay linked; the last label stays.

    The address is changed in lower case and gets the capitals of the one found, so its spellings stay linked.
    """
    local, _, host = found.lower().partition("@")
    host, _, last = host.rpartition(".")
    changed = f"{_like(permute, 'local', local)}@{_like(permute, 'host', host, last)}.{last}"
    return "".join(c.upper() if was.isupper() else c for c, was in zip(changed, found))


def secret(permute: Permutation, found: str) -> str | None:
    """Access keys and quoted or assigned tokens: the part that is secret changes within its kinds (hexadecimal stays so).

    What it is assigned to has no say, so that a secret stays linked.
    """
    head, mark, body = re.fullmatch(rf"([A-Za-z_]+\s*[=:]\s*[\"']?)?({KEY_MARKS})?(.*)", found, re.S).groups()
    head, mark = head or "", mark or ""
    if all(c in HEX for c in body):
        return head + mark + _mixed(permute, f"hex|{len(body)}", [(HEX, c) for c in body])
    return head + mark + _like(permute, "secret", body, mark)


def international(permute: Permutation, found: str) -> str | None:
    """Numbers with a country code: 8 to 15 digits; the code stays."""
    digits = re.sub(r"\D", "", found)
    code = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    if not 8 <= len(digits) <= 15:
        return None
    return _put(found, digits[:code] + _mixed(permute, f"international|{digits[:code]}", [(DIGITS, c) for c in digits[code:]]))


def address6(permute: Permutation, found: str) -> str | None:
    """IPv6 addresses with three groups or more: groups that are zero stay so, the others keep their number of digits.

    Leading zeros, left out groups and capitals are written as they were found, so the spellings of an address stay linked.
    """
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return None
    groups = [g for g in found.split(":") if g]
    if len(groups) < 3:
        return None
    bare = [g.lstrip("0").lower() for g in groups]
    shape = ":".join(str(len(g)) for g in ipaddress.IPv6Address(found).exploded.split(":") for g in [g.lstrip("0")])
    places = [("123456789abcdef" if i == 0 else HEX, c) for g in bare for i, c in enumerate(g)]
    new = "".join(c for _, c in places)
    capitals = any(c in "ABCDEF" for c in found)
    lettered = any(c in "abcdef" for c in new)
    while True:
        # Walked until it has letters if it had, so that capitals can be told from it.
        new = _mixed(permute, f"v6|{shape}", [(a, c) for (a, _), c in zip(places, new)])
        if any(c in "abcdef" for c in new) == lettered:
            break
    turn = iter(new.upper() if capitals else new)
    parts = iter("0" * (len(g) - len(b)) + "".join(next(turn) for _ in b) for g, b in zip(groups, bare))
    return ":".join(next(parts) if g else "" for g in found.split(":"))


# Tried in this order at each place of a text. The digits before and behind a number keep it from being part of a longer one.
KINDS: dict[str, tuple[str, Callable[[Permutation, str], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", email),
    "secret": (
        r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
        r"|(?<![A-Za-z0-9_-])(?:sk-|gh[opsu]_|glpat-|xox[abp]-)(?=[A-Za-z_-]{0,63}[0-9])[A-Za-z0-9_-]{16,255}(?![A-Za-z0-9_-])"
        r"|(?<![A-Za-z0-9])(?:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z_-]{0,63}[0-9])[A-Za-z0-9_-]{8,128}(?![A-Za-z0-9_-])",
        secret,
    ),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban),
    "named_date": (
        rf"(?<![\w./-])(?:(?:[12][0-9]|3[01]|[1-9]) (?:{MONTH}),? (?:19|20)[0-9]{{2}}|(?:{MONTH}) (?:[12][0-9]|3[01]|[1-9]),? (?:19|20)[0-9]{{2}})(?![\w-])",
        date,
    ),
    "date": (r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?!(?!T[0-9]{2})[\w/-]|\.[0-9])", date),
    "social": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", social),
    "phone": (r"(?<![\w+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])", phone),
    "international": (r"(?<![\w+])\+[2-9](?:[ .-]?\(?[0-9]{1,5}\)?){2,7}(?![\w-])", international),
    "card": (r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", card),
    "address": (r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])", address),
    "address6": (r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.[0-9])", address6),
}
# Patterns that may run into the words behind a value: how much of a match is the value (0: none).
LENGTHS: dict[str, Callable[[str], int]] = {"iban": iban_length, "card": card_length}
# Every value has one of these, and reaches no further before its first or behind its last one than the two numbers say.
HINT = re.compile(r"[0-9@]|AKIA")
BEFORE, BEHIND = 160, 700


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """The parts of a text that can hold values, in order; the rest is not searched with the long pattern."""
    start, end = 0, -1
    for m in HINT.finditer(text):
        if m.start() - BEFORE > end:
            if end >= 0:
                yield start, min(end, len(text))
            start = max(0, m.start() - BEFORE)
        end = m.end() + BEHIND
    if end >= 0:
        yield start, min(end, len(text))


def _finder(kinds: tuple[str, ...]) -> re.Pattern:
    # Group numbers shift inside the joined pattern, so the references to a date's mark are named.
    parts = []
    for k in kinds:
        pattern = KINDS[k][0]
        for n in (1, 2):
            pattern = pattern.replace("([-/.])", f"(?P<mark{n}>[-/.])", 1).replace(f"\\{n}", f"(?P=mark{n})")
        parts.append(f"(?P<{k}>{pattern})")
    return re.compile("|".join(parts), re.ASCII)


class Rewriter:
    """Replaces the values of a text; the pattern is compiled once in each worker process."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = tuple(KINDS), back: bool = False) -> None:
        self.permute = Permutation(key, back)
        self.kinds = kinds
        self.pattern: re.Pattern | None = None

    def replacements(self, text: str) -> Iterator[tuple[str, int, int, str]]:
        """(kind, start, end, pseudonym) of every validated value, in order."""
        if self.pattern is None:
            self.pattern = _finder(self.kinds)
        at = 0
        for start, end in _regions(text):
            at = max(at, start)
            while m := self.pattern.search(text, at, end):
                # Not valid as this kind: a value of another kind may begin here, or one character on.
                found = self._value(m.lastgroup, m) or self._other(text, m, end)
                if found:
                    yield found
                at = found[2] if found else m.start() + 1

    def _value(self, kind: str, m: re.Match) -> tuple[str, int, int, str] | None:
        length = LENGTHS.get(kind, len)(m[0])
        new = KINDS[kind][1](self.permute, m[0][:length]) if length else None
        return None if new is None else (kind, m.start(), m.start() + length, new)

    def _other(self, text: str, m: re.Match, end: int) -> tuple[str, int, int, str] | None:
        for k in self.kinds[self.kinds.index(m.lastgroup) + 1 :]:
            found = _finder((k,)).match(text, m.start(), end)
            value = found and self._value(k, found)
            if value:
                return value
        return None

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        out, at, spans = [], 0, []
        for kind, start, end, new in self.replacements(text):
            out += [text[at:start], new]
            spans.append((kind, start, end))
            at = end
        return ("".join(out) + text[at:] if out else text), spans


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
REWRITTEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])


def rewritten(docs: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS), back: bool = False) -> Column:
    """A column (text, spans) made from the texts of ``docs``; ``back`` turns pseudonyms into the values they stand for."""
    rewriter = send(docs.sparkSession, Rewriter, key=key, kinds=kinds, back=back)

    @F.pandas_udf(REWRITTEN)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = []
            for t in series:
                new, spans = rewriter()(t) if t is not None else (None, [])
                rows.append((new, [{"kind": k, "first": a, "last": b} for k, a, b in spans]))
            yield pd.DataFrame(rows, columns=["text", "spans"])

    return run(F.col(text).cast("string"))


def pseudonymise(docs: DataFrame, key: bytes, id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(id, text, n_values, spans) of every row: the text with pseudonyms, how many there are, and where the values stood.

    Spans are character ranges [first, last) of the text given. A null text stays null, an empty one empty; repeated rows get
    equal results; an empty table gives an empty one. What does not validate (wrong check digit, impossible date) stays as it is.
    """
    changed = docs.select(id, rewritten(docs, key, text, back=back).alias("__new"))
    return changed.select(id, F.col("__new.text").alias("text"), F.size("__new.spans").cast("long").alias("n_values"), F.col("__new.spans").alias("spans"))


def replace_values(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with pseudonyms in the text; every other column stays."""
    changed = docs.withColumn("__new", rewritten(docs, key, text))
    return changed.select(*(F.col("__new.text").alias(c) if c == text else F.col(c) for c in docs.columns))
