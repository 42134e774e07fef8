"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation are replaced by the image of a
keyed permutation of their own format: a Feistel network over the format's
value range, walked on until the image is valid too. Equal values get equal
pseudonyms in every document, different values different ones, and the holder
of the key can invert it. Separators, lengths and check digits stay as they are
or are made right again.

Kinds: card (13 to 19 digits, Luhn), iban (mod 97), ssn, phone, ip, date
(1900 to 2099, real days), email (its local part, letter for letter and digit
for digit).

A card or IBAN that more digits or capitals follow (an expiry date, a currency)
is found as the longest valid beginning of the match that ends at a separator,
an IBAN at its country's length. Of such a beginning the permutation is walked
past values that would be valid at greater length, so that it can be inverted;
about one in ten cards with an odd number of digits behind gets a pseudonym of
its own there.

Defined cases. A null text counts as empty. Texts are read whole. What fails
its validation stays as it is. Rows with null or repeated ids are each treated;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
ROUNDS = 8
LOCAL_CHUNK = 64  # the length that mail allows a local part
_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST

# Fixed values of the IBAN registry.
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24
DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30
KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25
QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}

_FIND = re.compile(r"""
    (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))
  | (?P<date>(?<![\d./-])(?:\d{4}(?P<d1>[-/.])\d{1,2}(?P=d1)\d{1,2}|\d{1,2}(?P<d2>[-/.])\d{1,2}(?P=d2)\d{4})(?![./-]?\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d))
  | (?P<phone>(?<![\w+])(?:\+\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}(?!\d)
            |(?<![\w+])\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,4}(?!\d)
            |(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d))
  | (?P<card>(?<![\d-])\d(?:[\x20-]?\d){12,18}(?!-?\d))
""", re.X | re.A)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of range(size): a Feistel network over the next even
    number of bits, walked on until the image lies in the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, need = (1 << half) - 1, (half + 7) // 8

    def mixed(r: int, x: int) -> int:
        said = f"{tweak}|{size}|{r}|{x}"
        out = hashlib.blake2b(said.encode(), key=key, digest_size=min(need, 64)).digest()
        for more in range(64, need, 64):  # a digest has 64 bytes at most
            out += hashlib.blake2b(f"{said}|{more}".encode(), key=key, digest_size=min(need - more, 64)).digest()
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ mixed(r, left), left
            else:
                left, right = right, left ^ mixed(r, right)
        value = left << half | right
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool], back: bool = False) -> int:
    """The permutation of the valid values alone, by walking past the others."""
    while True:
        value = feistel(value, size, key, tweak, back)
        if valid(value):
            return value


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _relay(pattern: str, digits: str) -> str:
    """``digits`` laid over the digits of ``pattern``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1


def _card(found: str, key: bytes, back: bool, behind: tuple[str, ...] = ()) -> str | None:
    """``behind``: what stands between ``found`` and each longer end that was tried."""
    d = "".join(filter(str.isdigit, found))
    if not _is_card(d):
        return None
    n = len(d) - 1
    more = ["".join(filter(str.isdigit, x)) for x in behind]

    def whole(v: int) -> str:
        body = f"{v:0{n}d}"
        return body + next(c for c in "0123456789" if luhn(body + c))

    def fits(v: int) -> bool:
        return len(set(f"{v:0{n}d}")) > 1 and not (more and any(_is_card(whole(v) + x) for x in more))

    return _relay(found, whole(walk(int(d[:-1]), 10**n, key, "card", fits, back)))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _symbols(text: str) -> tuple[int, int]:
    """(value, range) of a text read position by position: digits among digits,
    letters among letters of their case; other characters carry nothing."""
    value, size = 0, 1
    for c in text:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value = value * base + (int(c) if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 0)
        size *= base
    return value, size


def _spell(pattern: str, value: int) -> str:
    out = []
    for c in reversed(pattern):
        if c.isdigit():
            value, x = divmod(value, 10)
            out.append(str(x))
        elif c.isalpha():
            value, x = divmod(value, 26)
            out.append(chr((97 if c.islower() else 65) + x))
        else:
            out.append(c)
    return "".join(reversed(out))


def _is_iban(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and _iban_number(plain[4:] + plain[:4]) % 97 == 1


def _iban(found: str, key: bytes, back: bool, behind: tuple[str, ...] = ()) -> str | None:
    """``behind`` as for cards."""
    plain = found.replace(" ", "")
    if not _is_iban(plain):
        return None
    value, size = _symbols(plain[4:])
    more = [x.replace(" ", "") for x in behind]

    def whole(v: int) -> str:
        body = _spell(plain[4:], v)
        return f"{plain[:2]}{98 - _iban_number(body + plain[:2] + '00') % 97:02d}{body}"

    fits = lambda v: not (more and any(_is_iban(whole(v) + x) for x in more))
    new = iter(whole(walk(value, size, key, "iban" + plain[:2], fits, back)))
    return "".join(next(new) if c != " " else c for c in found)


def _ip(found: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(found: str, key: bytes, back: bool) -> str | None:
    sep = next(c for c in found if not c.isdigit())
    a, b, c = found.split(sep)
    year_first = len(a) == 4
    # 13/12 can only be day first and 12/13 month first; an open case is read day first
    month_first = not year_first and int(b) > 12
    y, m, d = (a, b, c) if year_first else (c, a, b) if month_first else (c, b, a)
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    wide = (len(m), len(d))

    def fits(v: int) -> bool:
        new = datetime.date.fromordinal(v + _FIRST)
        # the reading must stay the same, and one-digit fields one digit
        ambiguous = not year_first and ((new.day > 12) != (int(d) > 12))
        return not ambiguous and all(w == 2 or n < 10 for w, n in zip(wide, (new.month, new.day), strict=True)) and all(
            w == 2 or n >= 1 for w, n in zip(wide, (new.month, new.day), strict=True))

    new = datetime.date.fromordinal(walk(day, _DAYS, key, "date", fits, back) + _FIRST)
    m, d = f"{new.month:0{wide[0]}d}", f"{new.day:0{wide[1]}d}"
    return sep.join([f"{new.year}", m, d] if year_first else [m, d, f"{new.year}"] if month_first else [d, m, f"{new.year}"])


def _ssn_valid(v: int) -> bool:
    area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(found: str, key: bytes, back: bool) -> str | None:
    value = int(found.replace("-", ""))
    return _relay(found, f"{walk(value, 10**9, key, 'ssn', _ssn_valid, back):09d}") if _ssn_valid(value) else None


def _phone(found: str, key: bytes, back: bool) -> str | None:
    lead = re.match(r"\+\d{1,3}(?=\D)|\+1|\+\d\d|", found)[0]
    rest = "".join(filter(str.isdigit, found[len(lead):]))
    if not 7 <= len(rest) <= 12:
        return None
    north = len(rest) == 10 and lead in ("", "+1")
    valid = (lambda v: f"{v:010d}"[0] in "23456789" and f"{v:010d}"[3] in "23456789") if north else lambda v: True
    if not valid(int(rest)):
        north, valid = False, lambda v: True  # written like a telephone number, so taken for one
    n = len(rest)
    tweak = f"phone{'+1' if north else lead}"
    return lead + _relay(found[len(lead):], f"{walk(int(rest), 10**n, key, tweak, valid, back):0{n}d}")


def _shorter(kind: str, found: str) -> list[int]:
    """Ends of the beginnings of a match that failed, longest first: before a
    separator, of 13 digits at least, or of the length of the IBAN's country."""
    ends = [i for i in range(len(found) - 1, 0, -1) if found[i] in " -"]
    if kind == "card":
        return [i for i in ends if sum(map(str.isdigit, found[:i])) >= 13]
    size = IBAN_LENGTH.get(found[:2])
    return [i for i in ends if len(found[:i].replace(" ", "")) == size or size is None]


_PERMUTE = {"card": _card, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


@lru_cache(100_000)
def pseudonym(kind: str, found: str, key: bytes, back: bool = False, behind: tuple[str, ...] = ()) -> str | None:
    """The pseudonym of a found value, or None where it fails its validation."""
    return _PERMUTE[kind](found, key, back, behind) if behind else _PERMUTE[kind](found, key, back)


def _shape(text: str) -> str:
    return re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", text))


@lru_cache(100_000)
def _short_local(local: str, key: bytes, back: bool, after: str = "") -> str:
    value, size = _symbols(local)
    return _spell(local, feistel(value, size, key, f"email{_shape(local)}{after}", back))


def _local_part(local: str, key: bytes, back: bool) -> str:
    """A local part of over ``LOCAL_CHUNK`` characters is permuted chunk by chunk,
    each under a tweak of the pseudonyms before it: still one to one, and linear."""
    if len(local) <= LOCAL_CHUNK:
        return _short_local(local, key, back)
    out, after = [], f"|{len(local)}"
    for at in range(0, len(local), LOCAL_CHUNK):
        part = local[at:at + LOCAL_CHUNK]
        new = _short_local.__wrapped__(part, key, back, after)
        out.append(new)
        after = "|" + hashlib.blake2b(f"{after}{part if back else new}".encode(), key=key, digest_size=16).hexdigest()
    return "".join(out)


def spans(text: str | None, key: bytes, back: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of what is replaced, by start."""
    text = text or ""
    out = []
    if "@" in text:
        out = [("email", m.start(1), m.end(1), _local_part(m[1], key, back)) for m in _EMAIL.finditer(text)]
    taken = [(s, e) for _, s, e, _ in out]
    at = 0
    while m := _FIND.search(text, at):
        at = m.end()
        kind = next(k for k in _PERMUTE if m[k])
        new, end = pseudonym(kind, m[0], key, back), m.end()
        if new is None and kind in ("card", "iban"):
            tried = [m.end()]
            for i in _shorter(kind, m[0]):
                end = m.start() + i
                new = pseudonym(kind, m[0][:i], key, back, tuple(text[end:x] for x in tried))
                if new is not None:
                    at = end
                    break
                tried.append(end)
        if new is None:
            at = m.start() + 1
            while at < len(text) and text[at].isdigit() and text[at - 1].isdigit():
                at += 1  # the rest of a run of digits is no value of its own
        elif not any(s < end and m.start() < e for s, e in taken):
            out.append((kind, m.start(), end, new))
    return sorted(out, key=lambda x: x[1])


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    found = spans(text, key, back)
    parts, at = [], 0
    for _, start, end, new in found:
        parts += [(text or "")[at:start], new]
        at = end
    return "".join([*parts, (text or "")[at:]]), found


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, text (pseudonymised), n_found, one count
    per kind, and spans as kind:start:end of the original, comma-joined."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, counts, where = [], [], []
            for text in pdf["text"]:
                new, found = pseudonymise(text, key)
                texts.append(new)
                counts.append(Counter(k for k, *_ in found))
                where.append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "n_found": [sum(c.values()) for c in counts],
                                **{f"n_{k}": [c[k] for c in counts] for k in KINDS}, "spans": where})

    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string")
