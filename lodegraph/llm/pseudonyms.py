"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network within their format.

Equal values get equal pseudonyms in every document, different values of one kind get different ones, and the holder of
the key can turn them back. Kinds, and what makes a candidate valid:

* ``card``: 13 to 19 digits, or groups of 4-4-4-4 or 4-6-5 set apart by blanks or hyphens, with a right Luhn digit; so is the pseudonym;
* ``iban``: a country code, two check digits and 11 to 30 digits or capitals, with a right mod-97 check, the longest groups that pass; so is the pseudonym;
* ``ssn``: ddd-dd-dddd outside the ranges that are never issued;
* ``phone``: + and 7 to 15 digits, in groups or not; ten digits as (ddd) ddd-dddd, ddd-ddd-dddd, ddd.ddd.dddd or ddd ddd dddd, also after a 1;
  ten bare digits whose area and exchange begin with 2 to 9; 0 and 8 to 11 digits in groups, or 9 bare ones; nine digits from 6 to 9 as ddd ddd ddd
  or ddd dd dd dd. Country code and first 0 stay, as does the first digit of the last forms; the rest is permuted. Groups set apart by blanks or points only are none next to more of them;
* ``ipv4``: four numbers of 0 to 255 without leading zeros;
* ``date``: yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or mm/dd/yyyy of a real day from 1900 to 2099, dd/mm/yyyy where mm/dd/yyyy is none, and all of these
  with days and months of one digit; so is the pseudonym, in the same form. Forms that only some days have (one digit, dd/mm/yyyy) have pseudonyms of their own;
* ``email``: the part before the @ is permuted letter by letter and digit by digit; capitals stay where they are, so that spellings in other cases stay linked.

What fails its check is left as it is. Defined results: a null text stays null, an empty one empty; repeated rows are
treated one by one; extra columns are ignored; an empty table gives an empty result; a null doc_id stays null; a text is
read whole in time linear in its length.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

ROUNDS = 8
#: For tests and examples; production passes its own secret.
DEMO_KEY = b"not a secret"

_NO_MORE = r"(?![0-9A-Za-z@]|[.-][0-9])"
_NOR_BLANK = r"(?![0-9A-Za-z@]|[ .-][0-9])"
#: International ones, ten digits with signs, and those that only blanks and points set apart, which must stand alone.
PHONE = (
    r"(?:(?<![0-9A-Za-z+])\+(?:[0-9]{1,3}[ -]?\([0-9]{3}\)[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])|1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|[1-9](?:[ .-]?[0-9]|[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]){6,14}(?![0-9]))"
    rf"|(?<![0-9A-Za-z+])(?<![0-9][.-])(?:(?:1[ .-]?)?\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|(?:1-)?[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}){_NO_MORE}"
    rf"|(?<![0-9A-Za-z+])(?<![0-9][ .-])(?:(?:1\.)?[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{4}}|(?:1 )?[0-9]{{3}} [0-9]{{3}} [0-9]{{4}}|0[1-9](?:[ .-][0-9]{{2}}){{4}}"
    rf"|[6-9][0-9]{{2}} (?:[0-9]{{3}} [0-9]{{3}}|[0-9]{{2}} [0-9]{{2}} [0-9]{{2}})|0[1-9][0-9]{{0,3}}(?: [0-9]{{3,8}}){{1,2}}){_NOR_BLANK}"
    rf"|(?<![0-9A-Za-z+.-])(?:[2-9][0-9]{{2}}[2-9][0-9]{{6}}|0[1-9][0-9]{{8}}){_NO_MORE})"
)
#: Country codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
BARE = re.compile("[2-9][0-9]{2}[2-9][0-9]{6}")

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "phone": PHONE,
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
EACH = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Every candidate has an @ or a digit near its start; what comes first in the text wins, then what comes first here.
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))

FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
DATE_FORMS = tuple(
    re.compile(p)
    for p in (r"(?P<y>\d{4})-(?P<m>\d\d?)-(?P<d>\d\d?)", r"(?P<y>\d{4})/(?P<m>\d\d?)/(?P<d>\d\d?)", r"(?P<d>\d\d?)\.(?P<m>\d\d?)\.(?P<y>\d{4})", r"(?P<m>\d\d?)/(?P<d>\d\d?)/(?P<y>\d{4})", r"(?P<d>\d\d?)/(?P<m>\d\d?)/(?P<y>\d{4})")
)


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1: an unbalanced Feistel network over Z_a x Z_b with cycle walking."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def mask(i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}:{size}:{i}:{half}".encode(), key=key[:64], digest_size=24).digest(), "big")

    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * mask(i, left)) % b
            else:
                left = (left + sign * mask(i, right)) % a
        value = left * b + right
        if value < size:
            return value


def luhn_sum(digits: str) -> int:
    doubled = (2 * int(c) for c in digits[-2::-2])
    return sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonymiser:
    def __init__(self, key: bytes = DEMO_KEY, back: bool = False):
        self.key, self.back = key, back
        self._of: Callable[[str, str], str | None] = lru_cache(maxsize=65_536)(self._compute)

    def _number(self, value: int, size: int, tweak: str) -> int:
        return permute(value, size, self.key, tweak, self.back)

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self._number(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))

    @staticmethod
    def _laid_out(like: str, chars: str) -> str:
        """``chars`` in the places of the letters and digits of ``like``."""
        rest = iter(chars)
        return "".join(next(rest) if c.isalnum() else c for c in like)

    def _card(self, found: str) -> str | None:
        digits = re.sub("[ -]", "", found)
        if luhn_sum(digits) % 10 or not digits.strip("0"):
            return None
        body = self._digits(digits[:-1], "card")
        check = -luhn_sum(body + "0") % 10
        return self._laid_out(found, f"{body}{check}")

    def _iban(self, found: str) -> str | None:
        bare = found.replace(" ", "")
        if not 15 <= len(bare) <= 34 or mod97(bare) != 1:
            return None
        value = size = 0
        size = 1
        for c in bare[4:]:  # a mixed-radix number: digits stay digits, letters stay letters
            radix = 10 if c.isdigit() else 26
            value, size = value * radix + (int(c) if c.isdigit() else ord(c) - 65), size * radix
        value = self._number(value, size, f"iban:{bare[:2]}")
        out = []
        for c in reversed(bare[4:]):
            value, digit = divmod(value, 10 if c.isdigit() else 26)
            out.append(str(digit) if c.isdigit() else chr(65 + digit))
        body = "".join(reversed(out))
        check = 98 - mod97(f"{bare[:2]}00{body}")
        return self._laid_out(found, f"{bare[:2]}{check:02d}{body}")

    def _ssn(self, found: str) -> str | None:
        area, group, serial = map(int, found.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        area_at = area - 1 - (area > 666)
        value = self._number((area_at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        value, serial = divmod(value, 9999)
        area_at, group = divmod(value, 99)
        return f"{area_at + 1 + (area_at >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if m := re.match(r"\+(\d{1,3})[ -]?\(\d{3}\)[ -]?\d{3}[ -]?\d{4}$", found):
            code = m[1]
        elif found[0] == "+":
            if not 7 <= len(digits) <= 15:
                return None
            code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
        elif digits[0] == "0":
            if not 9 <= len(digits) <= 12:
                return None
            code = "0"
        elif len(digits) == 9:
            code = digits[0]
        elif len(digits) == len(found):  # bare: the pseudonym must look like a phone too
            while not BARE.fullmatch(digits := self._digits(digits, "phone:bare")):
                pass
            return digits
        else:
            return self._laid_out(found, digits[:-10] + self._digits(digits[-10:], "phone:1"))
        return self._laid_out(found, code + self._digits(digits[len(code) :], f"phone:{code}"))

    def _ipv4(self, found: str) -> str | None:
        parts = found.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        value = self._number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _date(self, found: str) -> str | None:
        for n, pattern in enumerate(DATE_FORMS):
            if m := pattern.fullmatch(found):
                try:
                    day = dt.date(int(m["y"]), int(m["m"]), int(m["d"])).toordinal()
                except ValueError:
                    continue
                if not FIRST_DAY <= day <= LAST_DAY:
                    return None
                while True:  # until the new day has the same form
                    day = FIRST_DAY + self._number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")
                    new = dt.date.fromordinal(day)
                    parts = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(m['m'])}d}", "d": f"{new.day:0{len(m['d'])}d}"}
                    if all(len(parts[k]) == len(m[k]) for k in "md") and (n < len(DATE_FORMS) - 1 or new.day > 12):
                        break
                order = sorted("ymd", key=m.start)
                return parts[order[0]] + found[m.end(order[0])] + parts[order[1]] + found[m.end(order[1])] + parts[order[2]]
        return None

    def _email(self, found: str) -> str:
        local, _, domain = found.partition("@")
        value, size = 0, 1
        radix = lambda c: 10 if c.isdigit() else 26 if c.isalpha() else 1
        for c in local:
            place = int(c) if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 0
            value, size = value * radix(c) + place, size * radix(c)
        shape = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in local)  # so that Bob and bob stay linked
        value = self._number(value, size, f"email:{shape}")
        out = []
        for c in reversed(local):
            value, place = divmod(value, radix(c))
            out.append(str(place) if c.isdigit() else chr((97 if c.islower() else 65) + place) if c.isalpha() else c)
        return f"{''.join(reversed(out))}@{domain}"

    def _compute(self, kind: str, found: str) -> str | None:
        return getattr(self, f"_{kind}")(found)

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in code points of the text as it was."""
        out, spans, done, at = [], [], 0, 0
        while m := ANY.search(text, at):
            kind, end = m.lastgroup, m.end()
            new = self._of(kind, m[0])
            while new is None and kind == "iban" and (blank := text.rfind(" ", m.start(), end)) > 0:
                end = blank  # words in capitals may follow
                new = self._of(kind, text[m.start() : end])
            if new is None:  # the same place may be of a later kind
                for k in KINDS[KINDS.index(kind) + 1 :]:
                    if (other := EACH[k].match(text, m.start())) and (new := self._of(k, other[0])) is not None:
                        kind, m, end = k, other, other.end()
                        break
            if new is None:  # another kind may begin within what failed
                at = m.start() + 1
                if m[0][0].isdigit():
                    while at < m.end() and text[at].isdigit():
                        at += 1
                continue
            out += [text[done : m.start()], new]
            spans.append((kind, m.start(), end))
            done = at = end
        return "".join([*out, text[done:]]), spans


SCHEMA = "doc_id long, text string, n_values long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_HAS_CANDIDATE = re.compile(r"[0-9@]")


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, back: bool = False, text_col: str = "text") -> DataFrame:
    """doc_id, the text with pseudonyms, counts by kind and the spans of each row; ``back`` turns pseudonyms back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonymiser(key, back)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(1).to_pylist():
                new, found = made.text(text) if text and _HAS_CANDIDATE.search(text) else (text, [])
                texts.append(new)
                spans.append(found)
            counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            rows = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], _SPANS)
            columns = [batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(list(map(len, spans)), pa.int64()), *counts, rows]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_values", *(f"n_{k}" for k in KINDS), "spans"])

    return map_batches(docs.select("doc_id", text_col), run, SCHEMA)


def op4_pseudonyms(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs)
