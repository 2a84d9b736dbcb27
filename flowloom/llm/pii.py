"""Personal data replaced by pseudonyms of the same format.

A number, date, address or key that passes its format's checks is mapped to a whole number below the
size of the format's domain, permuted there by a keyed Feistel network, and written back in the same
format: same length, separators and case, valid check digits, valid days. The permutation depends on
the key and the kind alone, so equal values get equal pseudonyms in every document, and different
values different ones. Nothing is shared between rows: no shuffle, no table of names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Used where the caller gives no key; a deployment passes a secret of its own.
KEY = b"flowloom"
#: Pseudonyms a task remembers, since the same values come again and again.
REMEMBERED = 100_000
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, kind: str, key: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over enough bits, walked
    until it comes back into the domain. Domains of one value stay as they are."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, length = (1 << half) - 1, (half + 7) // 8
    tweak = f"{kind}:{size}:".encode()
    while True:
        left, right = value >> half, value & mask
        for turn in range(ROUNDS):
            data = tweak + bytes([turn]) + right.to_bytes(length, "big")
            mixed = b"".join(
                hashlib.blake2b(data + bytes([part]), key=key, digest_size=64).digest()
                for part in range(-(-length // 64))
            )
            left, right = right, left ^ (int.from_bytes(mixed[:length], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_digits(digits: str, kind: str, key: bytes) -> str:
    return str(permute(int(digits), 10 ** len(digits), f"{kind}{len(digits)}", key)).zfill(len(digits))


ALPHABETS = [string.digits, string.ascii_lowercase, string.ascii_uppercase]


def permute_text(text: str, kind: str, key: bytes, alphabets: list[str] = ALPHABETS) -> str:
    """Every character is replaced by one of its own alphabet; others stay. The characters are the
    digits of one number in mixed radix, so all of them decide about each."""
    home = [next((a for a in alphabets if c in a), None) for c in text]
    value, size = 0, 1
    for char, alphabet in zip(text, home):
        if alphabet:
            value, size = value * len(alphabet) + alphabet.index(char), size * len(alphabet)
    shape = "".join(str(alphabets.index(a)) if a else c for c, a in zip(text, home))
    value, out = permute(value, size, f"{kind}:{shape}", key), []
    for char, alphabet in zip(reversed(text), reversed(home)):
        if alphabet:
            value, at = divmod(value, len(alphabet))
            char = alphabet[at]
        out.append(char)
    return "".join(reversed(out))


def refill(shown: str, digits: str) -> str:
    """`shown` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shown)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, char in enumerate(reversed(payload)):
        doubled = int(char) * (2 if i % 2 == 0 else 1)
        total += doubled - 9 * (doubled > 9)
    return str(-total % 10)


def is_luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


#: Card numbers by issuer: first and last prefix, lengths. Fixed values of the issuers.
ISSUERS = [
    ("4", "4", (13, 16, 19)),
    ("51", "55", (16,)),
    ("2221", "2720", (16,)),
    ("34", "34", (15,)),
    ("37", "37", (15,)),
    ("300", "305", (14,)),
    ("36", "36", (14,)),
    ("38", "39", (14,)),
    ("3528", "3589", (16, 17, 18, 19)),
    ("6011", "6011", (16, 17, 18, 19)),
    ("644", "649", (16, 17, 18, 19)),
    ("65", "65", (16, 17, 18, 19)),
    ("62", "62", (16, 17, 18, 19)),
    ("5018", "5018", (13, 14, 15, 16, 17, 18, 19)),
    ("5020", "5020", (13, 14, 15, 16, 17, 18, 19)),
    ("5038", "5038", (13, 14, 15, 16, 17, 18, 19)),
    ("5893", "5893", (13, 14, 15, 16, 17, 18, 19)),
    ("6304", "6304", (13, 14, 15, 16, 17, 18, 19)),
    ("6759", "6763", (13, 14, 15, 16, 17, 18, 19)),
]
#: Sizes of the groups that a card is printed in; the last is as long as it needs to be.
PRINTED = [(4, 4, 4), (4, 4, 4, 4), (4, 6)]
#: Four-digit groups in a row that may hold a card beside a number that is none.
CHAIN = 5


def issuer_digits(digits: str) -> int:
    """How many digits of a valid card number name its issuer; 0 for other numbers."""
    for first, last, lengths in ISSUERS:
        if len(digits) in lengths and first <= digits[: len(first)] <= last:
            return len(first) if is_luhn(digits) else 0
    return 0


def _card_end(groups: list[str], marks: list[str], at: int) -> int:
    """Where the longest card that starts with group `at` ends; `at` if none does."""
    found = at + 1 if issuer_digits(groups[at]) else at
    for sizes in PRINTED:
        end = at + len(sizes) + 1
        here = groups[at:end]
        printed = len(here) == len(sizes) + 1 and tuple(map(len, here[:-1])) == sizes
        if printed and len(set(marks[at : end - 1])) == 1 and issuer_digits("".join(here)):
            found = max(found, end)
    return found


def _cards(run: str, key: bytes) -> str | None:
    """Card numbers in a run of digits: an issuer's prefix and length, the Luhn check, and no groups or
    those that cards are printed in; the leftmost first, then the longest. In a row of more than CHAIN
    four-digit groups, as tables have them, groups are cards only if all of them are."""
    groups, marks = re.findall(r"\d+", run), re.findall(r"\D", run)
    ends, at, table = {}, 0, 0
    while at < len(groups):
        if at >= table and len(groups[at]) == 4:
            stop = at + 1
            while stop < len(groups) and len(groups[stop]) == 4 and marks[stop - 1] == marks[at]:
                stop += 1
            table = stop
            if stop - at > CHAIN and any(_card_end(groups, marks, i) != i + 4 for i in range(at, stop, 4)):
                at = stop
                continue
        end = _card_end(groups, marks, at)
        if end > at:
            ends[at] = end
        at = max(end, at + 1)
    if not ends:
        return None
    for at, end in ends.items():
        digits = "".join(groups[at:end])
        kept = digits[: issuer_digits(digits)]
        payload = kept + permute_digits(digits[len(kept) : -1], f"card{kept}-", key)
        rest = iter(payload + luhn_digit(payload))
        groups[at:end] = ["".join(next(rest) for _ in group) for group in groups[at:end]]
    return "".join(x for pair in zip(groups, [*marks, ""]) for x in pair)


def _address(shown: str, key: bytes) -> str | None:
    octets = [int(x) for x in shown.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in shown.split(".")):
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip", key)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(shown: str, key: bytes) -> str | None:
    digits = shown.replace("-", "")
    if not _valid_ssn(digits):
        return None
    digits = permute_digits(digits, "ssn", key)
    while not _valid_ssn(digits):  # valid numbers are permuted among themselves
        digits = permute_digits(digits, "ssn", key)
    return refill(shown, digits)


def _phone(shown: str, key: bytes) -> str | None:
    """The country code stays, the national number is permuted."""
    code = re.match(r"\+\d{1,3}(?=\D)|\+\d{2}|", shown)[0]
    digits = re.sub(r"\D", "", shown[len(code) :])
    return code + refill(shown[len(code) :], permute_digits(digits, "phone", key)) if 7 <= len(digits) <= 13 else None


def _iban(shown: str, key: bytes) -> str | None:
    plain = shown.replace(" ", "")
    check = lambda country, bban: int("".join(str(int(c, 36)) for c in bban + country + "00"))
    country, bban = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or 98 - check(country, bban) % 97 != int(plain[2:4]):
        return None
    bban = permute_text(bban, f"iban{country}", key, [string.digits, string.ascii_uppercase])
    rest = iter(country + f"{98 - check(country, bban) % 97:02d}" + bban)
    return "".join(c if c == " " else next(rest) for c in shown)


#: Length of a country's numbers.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _iban_ends(shown: str) -> list[str]:
    """What a proposed number can be, since capitals and digits after it are proposed with it: the
    part of its country's length, then all of it, then, where no length is known, parts of whole words."""
    ends = [m.start() for m in re.finditer(r" |$", shown)]
    length = IBAN_LENGTHS.get(shown[:2])
    size = {end: end - shown.count(" ", 0, end) for end in ends}
    parts = [shown[:end] for end in reversed(ends) if 15 <= size[end] and length in (None, size[end])]
    return list(dict.fromkeys([*parts, shown]))


def _date(shown: str, key: bytes) -> str | None:
    a, mark, b, _, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", shown).groups()
    if len(a) == 4:
        order = "ymd"
    elif mark == "/" and int(a) <= 12:
        order = "mdy"  # where both orders fit
    else:
        order = "dmy"
    got = dict(zip(order, (a, b, c)))
    try:
        day = datetime.date(int(got["y"]), int(got["m"]), int(got["d"])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    size = LAST_DAY - FIRST_DAY + 1
    new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, size, "date", key))
    put = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(put[x] for x in order)


def _email(shown: str, key: bytes) -> str | None:
    """Name and domain are permuted, the top-level domain stays."""
    name, dot, top = shown.rpartition(".")
    return permute_text(name, "email", key) + dot + top


def _secret(shown: str, key: bytes) -> str | None:
    alphabet = [string.digits + ("ABCDEF" if shown.upper() == shown else "abcdef")]
    return permute_text(shown, "secret", key, alphabet)


#: Kind -> (pattern, pseudonym). Patterns only propose; a kind that refuses leaves the text to the next.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24}\b", _email),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", _iban),
    "secret": (r"\b(?=[a-fA-F]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b", _secret),
    "date": (r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])", _date),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _address),
    "phone": (
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
        r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
        _phone,
    ),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "card": (r"(?<![\d.])\d(?:[ -]?\d){12,}(?!\d)", _cards),
}
#: What to try of a proposal, and where to look on after one that is refused: at its next word.
PARTS: dict[str, Callable[[str], list[str]]] = {"iban": _iban_ends}
MAYBE = re.compile(r"[0-9@]")


class Pseudonyms:
    """Replaces personal data in texts; holds no more than what it remembers of past values."""

    def __init__(self, key: bytes = KEY, kinds: tuple[str, ...] = tuple(KINDS)):
        self.key, self.known = key, {}
        self.kinds = [(k, re.compile(KINDS[k][0]), KINDS[k][1]) for k in kinds]

    def of(self, kind: str, make, shown: str) -> str | None:
        if (kind, shown) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, shown] = make(shown, self.key)
        return self.known[kind, shown]

    def found(self, kind: str, pattern: re.Pattern, make, text: str, start: int, end: int) -> Iterator[tuple[int, str, str]]:
        """(start, value, pseudonym) of what a kind takes between two places."""
        if kind not in PARTS:
            for match in pattern.finditer(text, start, end):
                new = self.of(kind, make, match[0])
                if new is not None:
                    yield match.start(), match[0], new
            return
        while match := pattern.search(text, start, end):
            start = match.start() + 1
            for shown in PARTS[kind](match[0]):
                new = self.of(kind, make, shown)
                if new is not None:
                    yield match.start(), shown, new
                    start = match.start() + len(shown)
                    break

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of each finding, in order; earlier kinds go first and later
        ones look only outside of what is taken."""
        taken: list[tuple[int, int, str, str]] = []
        free = [(0, len(text))] if MAYBE.search(text) else []
        for kind, pattern, make in self.kinds:
            rest = []
            for start, end in free:
                at = start
                for begin, shown, new in self.found(kind, pattern, make, text, start, end):
                    taken.append((begin, begin + len(shown), kind, new))
                    rest.append((at, begin))
                    at = begin + len(shown)
                rest.append((at, end))
            free = rest
        return sorted(taken)

    def replace(self, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, end, _, new in self.spans(text):
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]) if out else text


def pseudonymize(docs: DataFrame, key: bytes = KEY, column: str = "text") -> DataFrame:
    """`docs` with the personal data in `column` replaced; all columns and rows stay.

    Null and empty texts stay as they are. Repeated rows get equal pseudonyms. An empty table gives
    an empty result.
    """

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        pseudonyms = Pseudonyms(key)
        return texts.map(pseudonyms.replace)

    return docs.withColumn(column, replaced(F.col(column)))


def findings(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """A row per finding in `docs` (doc_id, text): doc_id, kind, start, length (code points), value,
    pseudonym. Texts without findings have no rows."""
    found = "array<struct<kind:string,start:int,length:int,value:string,pseudonym:string>>"

    @F.pandas_udf(found)
    def spans(texts: pd.Series) -> pd.Series:
        pseudonyms = Pseudonyms(key)
        return texts.map(
            lambda text: [
                {"kind": kind, "start": start, "length": end - start, "value": text[start:end], "pseudonym": new}
                for start, end, kind, new in pseudonyms.spans(text or "")
            ]
        )

    return docs.select("doc_id", F.explode(spans("text")).alias("x")).select("doc_id", "x.*")
