"""Format-preserving pseudonyms for personal data.

Values are found by pattern, checked (card numbers by their check digit, account numbers by their remainder, dates by the
calendar, addresses by their ranges), and replaced by a keyed permutation within their own format: a Feistel network over the
smallest even number of bits that holds the format's values, walked until the result is such a value again. Equal values
therefore get equal pseudonyms in every document, different values never share one, the length of the text stays, and whoever
holds the key can invert the map. What fails its check stays as it is.

Defined cases: a null text stays null with no findings; all other columns pass through untouched; repeated rows get equal results.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)

PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{1,2}\5[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\6[0-9]{4})(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
)


class Permutation:
    """Keyed permutations of the whole numbers below any bound."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, label: bytes, number: int, half: int, value: int) -> int:
        text = label + bytes([number]) + value.to_bytes((half + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=min(64, half // 8 + 8)).digest(), "big") & ((1 << half) - 1)

    def _once(self, value: int, half: int, label: bytes) -> int:
        left, right = value >> half, value & ((1 << half) - 1)
        for number in range(ROUNDS):
            left, right = right, left ^ self._mix(label, number, half, right)
        return left << half | right

    def _back(self, value: int, half: int, label: bytes) -> int:
        left, right = value >> half, value & ((1 << half) - 1)
        for number in reversed(range(ROUNDS)):
            left, right = right ^ self._mix(label, number, half, left), left
        return left << half | right

    def apply(self, value: int, size: int, label: str, fits: Callable[[int], bool] = lambda _: True, inverse: bool = False) -> int:
        """The image of ``value`` among the numbers below ``size`` that fit; ``value`` must fit itself."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        step = self._back if inverse else self._once
        tag = f"{label}|{size}|".encode()
        while True:
            value = step(value, half, tag)
            if value < size and fits(value):
                return value


def _with_digits(text: str, digits: str) -> str:
    """Put new digits in the places of the old ones."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in text)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _mask(text: str) -> str:
    return re.sub(r"[0-9]", "0", text)


def luhn_digit(body: str) -> str:
    """The check digit that makes a card number valid."""
    total = 0
    for k, c in enumerate(reversed(body)):
        x = int(c) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _card(text: str, p: Permutation, inverse: bool) -> str | None:
    digits = _digits(text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    same = lambda v: len(set(f"{v:0{n}d}" + luhn_digit(f"{v:0{n}d}"))) > 1
    body = f"{p.apply(int(digits[:-1]), 10**n, 'card', same, inverse):0{n}d}"
    return _with_digits(text, body + luhn_digit(body))


def _iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, p: Permutation, inverse: bool) -> str | None:
    """Country and letters stay; the digits of the account are permuted and the two check digits follow."""
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_remainder(flat) != 1 or flat[2:4] in ("00", "01", "99"):
        return None
    account = _digits(flat[4:])
    if not account:
        return None
    new = f"{p.apply(int(account), 10 ** len(account), 'iban' + re.sub('[0-9]', '0', flat[4:]) + flat[:2], inverse=inverse):0{len(account)}d}"
    body = _with_digits(flat[4:], new)
    check = f"{98 - _iban_remainder(flat[:2] + '00' + body):02d}"
    return _with_digits(text, check + new)


def _ip(text: str, p: Permutation, inverse: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    show = lambda v: ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    value = sum(int(x) << s for x, s in zip(parts, (24, 16, 8, 0), strict=True))
    form = _mask(text)
    return show(p.apply(value, 2**32, "ip", lambda v: _mask(show(v)) == form, inverse))


def _day_of(text: str, year_first: bool, day_first: bool) -> dt.date | None:
    a, b, c = (int(x) for x in re.split(r"[-/.]", text))
    try:
        day = dt.date(a, b, c) if year_first else dt.date(c, b, a) if day_first else dt.date(c, a, b)
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _date(text: str, p: Permutation, inverse: bool) -> str | None:
    """Year first, else day first, else month first; the image is read the same way."""
    year_first = text[:4].isdigit()
    day_first = _day_of(text, year_first, True) is not None
    day = _day_of(text, year_first, day_first)
    if day is None:
        return None
    form, mark = _mask(text), re.sub(r"[0-9]", "", text)[0]
    widths = [len(x) for x in re.split(r"[-/.]", text)]

    def show(number: int) -> str:
        d = FIRST_DAY + dt.timedelta(days=number)
        parts = (d.year, d.month, d.day) if year_first else (d.day, d.month, d.year) if day_first else (d.month, d.day, d.year)
        return mark.join(f"{x:0{w}d}" for x, w in zip(parts, widths, strict=True))

    def fits(number: int) -> bool:
        new = show(number)
        return _mask(new) == form and (year_first or (_day_of(new, False, True) is not None) == day_first)

    size = (LAST_DAY - FIRST_DAY).days + 1
    return show(p.apply((day - FIRST_DAY).days, size, "date", fits, inverse))


def _ssn(text: str, p: Permutation, inverse: bool) -> str | None:
    def valid(v: int) -> bool:
        s = f"{v:09d}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    value = int(_digits(text))
    return _with_digits(text, f"{p.apply(value, 10**9, 'ssn', valid, inverse):09d}") if valid(value) else None


def _phone(text: str, p: Permutation, inverse: bool) -> str | None:
    """The country code stays."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    kept = code.group() if code else ""
    digits = _digits(text[len(kept) :])
    if not 7 <= len(digits) <= 15:
        return None
    return kept + _with_digits(text[len(kept) :], f"{p.apply(int(digits), 10 ** len(digits), 'phone' + kept, inverse=inverse):0{len(digits)}d}")


def _email(text: str, p: Permutation, inverse: bool) -> str | None:
    """Letters and digits before the @ are permuted, each within its kind; the rest stays."""
    name, _, domain = text.partition("@")
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in name]
    base = [ord("0") if c.isdigit() else ord("a") if c.islower() else ord("A") for c in name]
    value = size = 0
    size = 1
    for c, r, b in zip(name, radix, base, strict=True):
        if r > 1:
            value, size = value * r + ord(c) - b, size * r
    if size == 1:
        return None
    form = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", _mask(name)))
    value = p.apply(value, size, f"email|{form}|{domain.lower()}", inverse=inverse)
    out = []
    for c, r, b in zip(reversed(name), reversed(radix), reversed(base), strict=True):
        if r > 1:
            value, x = divmod(value, r)
            out.append(chr(b + x))
        else:
            out.append(c)
    return "".join(reversed(out)) + "@" + domain


MAPS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
NUMBER = re.compile(r"[0-9@]")


def pseudonymise(text: str, p: Permutation, inverse: bool = False) -> tuple[str, Counter]:
    """The text with pseudonyms in place, and how many values of each kind it held."""
    found: Counter = Counter()
    if not NUMBER.search(text):
        return text, found

    def swap(m: re.Match) -> str:
        # what fails the check of its own pattern may still be a value of a later kind, for example a card number in groups
        for kind in (m.lastgroup, *KINDS[KINDS.index(m.lastgroup) + 1 :]):
            if kind == m.lastgroup or _whole(kind, m):
                new = MAPS[kind](m.group(), p, inverse)
                if new is not None:
                    found[kind] += 1
                    return new
        return m.group()

    return PATTERN.sub(swap, text), found


def _whole(kind: str, m: re.Match) -> bool:
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", m.group()) is not None
    return False


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text column; all other columns unchanged."""
    return _judged(docs, key, text_col, inverse).select(*[_back(c, text_col) for c in docs.columns])


def _back(name: str, text_col: str):  # noqa: ANN202
    return F.col("_pii.text").alias(name) if name == text_col else F.col(f"_row.`{name}`")


def _judged(docs: DataFrame, key: bytes, text_col: str, inverse: bool) -> DataFrame:
    schema = "text string, " + ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(schema)
    def swap(texts: pd.Series) -> pd.DataFrame:
        p = Permutation(key)
        done = [(None, Counter()) if t is None else pseudonymise(t, p, inverse) for t in texts]
        columns = {"text": pd.Series([t for t, _ in done], dtype=object)}
        return pd.DataFrame(columns | {f"n_{k}": pd.Series([n[k] for _, n in done], dtype="int64") for k in KINDS})

    return docs.select(F.struct("*").alias("_row"), swap(F.col(text_col).cast("string")).alias("_pii"))


def report(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the new text, the number of values found of each kind and of all."""
    total = sum((F.col(f"_pii.n_{k}") for k in KINDS[1:]), F.col(f"_pii.n_{KINDS[0]}"))
    found = _judged(docs.select(id_col, text_col), key, text_col, False)
    return found.select(F.col(f"_row.`{id_col}`").alias("doc_id"), "_pii.*", total.alias("n_found"))
