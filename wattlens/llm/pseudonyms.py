"""Private data: format-preserving Feistel pseudonyms.

Found values are validated (checksums, ranges, calendar) and permuted, under a key, inside
their own format: a card number becomes a card number with a right check digit, a date a
date, an address of a machine another one. A value's pseudonym depends on key and value
only, so equal values stay linked across documents, and with the key it can be undone.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b, shake_256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_batches

ROUNDS = 10
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
LONG = 64  # letters and digits; beyond, a half holds more bits than a round's number
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def feistel(a: int, b: int, size_a: int, size_b: int, key: bytes, tweak: str, undo: bool = False) -> tuple[int, int]:
    """Keyed permutation of the pairs (a < size_a, b < size_b): each round shifts one half by a
    keyed function of the other."""
    def keyed(i: int, x: int) -> int:
        said = f"{tweak}|{size_a}|{size_b}|{i}|{x}".encode()
        return int.from_bytes(blake2b(said, key=key, digest_size=24).digest(), "big")

    for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS)):
        sign = -1 if undo else 1
        if i % 2:
            b = (b + sign * keyed(i, a)) % size_b
        else:
            a = (a + sign * keyed(i, b)) % size_a
    return a, b


def permute_number(x: int, size: int, key: bytes, tweak: str, fits: Callable[[int], bool] = lambda x: True, undo: bool = False) -> int:
    """Keyed permutation of those of 0 .. size - 1 that fit; walks on until a number fits."""
    half = int(size ** 0.5) + 1
    while True:
        a, b = feistel(x // half, x % half, half, half, key, tweak, undo)
        x = a * half + b
        if x < size and fits(x):
            return x


def _has_letter(x: int, size: int) -> bool:
    while size > 1:
        if x % 16 >= 10:
            return True
        x, size = x // 16, size // 16
    return False


def feistel_digits(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, key: bytes, tweak: str, undo: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``feistel`` place by place, for halves of any length: each round shifts every place of one
    half, within its alphabet, by a keyed stream made from the whole other half."""
    formats = blake2b(sizes_a.astype("<u4").tobytes() + b"|" + sizes_b.astype("<u4").tobytes(), key=key).hexdigest()

    def keyed(i: int, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        seed = blake2b(f"{tweak}|{formats}|{i}|".encode() + x.astype("<u4").tobytes(), key=key).digest()
        return (np.frombuffer(shake_256(seed).digest(8 * len(sizes)), "<u8") % sizes.astype(np.uint64)).astype(np.int64)

    for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS)):
        sign = -1 if undo else 1
        if i % 2:
            b = (b + sign * keyed(i, a, sizes_b)) % sizes_b
        else:
            a = (a + sign * keyed(i, b, sizes_a)) % sizes_a
    return a, b


def permute_text(value: str, key: bytes, tweak: str, undo: bool = False) -> str:
    """Permutes letters among letters and digits among digits (hexadecimal strings among such);
    other characters and the case of letters stay in their places."""
    low = value.lower()
    alnum = [i for i, c in enumerate(low) if c in DIGITS or c in LOWER]
    if not alnum:
        return value
    hexed = len(alnum) >= 16 and all(low[i] in HEX for i in alnum) and any(low[i] in DIGITS for i in alnum) and any(low[i] in LOWER for i in alnum)
    alphabets = [HEX if hexed else DIGITS if low[i] in DIGITS else LOWER for i in alnum]
    cut = len(alnum) // 2
    out = list(value)
    if len(alnum) > LONG:
        places = np.array([letters.index(low[i]) for i, letters in zip(alnum, alphabets)])
        sizes = np.array([len(letters) for letters in alphabets])
        a, b = places[:cut], places[cut:]
        while True:
            a, b = feistel_digits(a, b, sizes[:cut], sizes[cut:], key, tweak, undo)
            places = np.concatenate([a, b])
            if not hexed or (places >= 10).any() and (places < 10).any():
                break
        for i, letters, d in zip(alnum, alphabets, places.tolist()):
            out[i] = letters[d].upper() if value[i].isupper() else letters[d]
        return "".join(out)

    def number(part: slice) -> tuple[int, int]:
        x, size = 0, 1
        for i, letters in zip(alnum[part], alphabets[part]):
            x, size = x * len(letters) + letters.index(low[i]), size * len(letters)
        return x, size

    (a, size_a), (b, size_b) = number(slice(0, cut)), number(slice(cut, None))
    while True:
        a, b = feistel(a, b, size_a, size_b, key, tweak, undo)
        if not hexed or _has_letter(a, size_a) or _has_letter(b, size_b):  # hexadecimal values stay told from decimal ones
            break
    for x, part in ((a, slice(0, cut)), (b, slice(cut, None))):
        for i, letters in zip(reversed(alnum[part]), reversed(alphabets[part])):
            x, d = divmod(x, len(letters))
            out[i] = letters[d].upper() if value[i].isupper() else letters[d]
    return "".join(out)


def _digits(value: str) -> str:
    return "".join(c for c in value if c in DIGITS)


def _refill(value: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in value)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _luhn(d: str) -> bool:
    return luhn_digit(d[:-1]) == d[-1]


def _after_card(old: str, new: str, rest: str, key: bytes, undo: bool) -> str:
    """The one to three digits behind a card of 16. Together they may be a valid longer number,
    which then becomes another one; what is none stays, but for those few that would look
    like one behind the new card: they change places with those that no longer do."""
    if _luhn(old + rest):
        body = permute_text(rest[:-1], key, "after card" + (new if undo else old), undo)
        return body + luhn_digit(new + body)
    return rest[:-1] + luhn_digit(old + rest[:-1]) if _luhn(new + rest) else rest


def card(value: str, key: bytes, undo: bool = False) -> str | None:
    """17 to 19 digits whose first 16 are a card count as that card with digits behind it (a
    check code, a month), so it has the same pseudonym as alone."""
    d = _digits(value)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1:
        return None

    def permuted(d: str) -> str:
        body = d[0] + permute_text(d[1:-1], key, "card" + d[0], undo)
        return body + luhn_digit(body)

    if len(d) > 16 and _luhn(d[:16]) and (len(d) < len(value) or _luhn(d)) and len(set(d[:16])) > 1:
        new = permuted(d[:16])
        return _refill(value, new + _after_card(d[:16], new, d[16:], key, undo))
    if not _luhn(d):
        return None
    d = permuted(d)
    while len(d) > 16 and _luhn(d[:16]):  # walks on until it can't be told for the other kind
        d = permuted(d)
    return _refill(value, d)


def _mod97(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


#: Characters of an IBAN by country: fixed values of its registry, and of countries outside it that use the format.
IBAN_LENGTH = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in names.split()}


def iban(value: str, key: bytes, undo: bool = False) -> str | None:
    v = value.replace(" ", "")
    if not 15 <= len(v) <= 34 or _mod97(v[:2], v[2:4], v[4:]) != 1:
        return None
    body = permute_text(v[4:], key, "iban" + v[:2], undo)
    made = iter(v[:2] + f"{98 - _mod97(v[:2], '00', body):02d}" + body)
    return "".join(" " if c == " " else next(made) for c in value)


def machine(value: str, key: bytes, undo: bool = False) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255:
        return None
    x = permute_number(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "machine", undo=undo)
    return ".".join(map(str, x.to_bytes(4, "big")))


def social(value: str, key: bytes, undo: bool = False) -> str | None:
    def fits(x: int) -> bool:
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    d = int(_digits(value))
    return _refill(value, f"{permute_number(d, 10**9, key, 'social', fits, undo):09d}") if fits(d) else None


def phone(value: str, key: bytes, undo: bool = False) -> str | None:
    head = re.match(r"\+\d{1,3}(?=\D)", value)
    fixed = head[0] if head else value[:2] if value[0] == "+" else ""
    rest = value[len(fixed):]
    if not 7 <= len(_digits(rest)) <= 14:
        return None
    return fixed + _refill(rest, permute_text(_digits(rest), key, "phone" + fixed, undo))


def date(value: str, key: bytes, undo: bool = False) -> str | None:
    mark = re.search(r"[^0-9]", value)[0]
    parts = value.split(mark)
    iso = len(parts[0]) == 4
    try:
        day = dt.date(int(parts[0]), int(parts[1]), int(parts[2])) if iso else dt.date(int(parts[2]), int(parts[1]), int(parts[0]))
    except ValueError:
        try:
            day = None if iso else dt.date(int(parts[2]), int(parts[0]), int(parts[1]))
        except ValueError:
            day = None
        if day is None or not 1900 <= day.year < 2100:
            return None
        new = dt.date.fromordinal(FIRST_DAY + permute_number(day.toordinal() - FIRST_DAY, DAYS, key, "date month first", lambda x: dt.date.fromordinal(FIRST_DAY + x).day > 12, undo))
        return f"{new.month:02d}{mark}{new.day:02d}{mark}{new.year}"
    if not 1900 <= day.year < 2100:
        return None
    new = dt.date.fromordinal(FIRST_DAY + permute_number(day.toordinal() - FIRST_DAY, DAYS, key, "date", undo=undo))
    return f"{new.year}{mark}{new.month:02d}{mark}{new.day:02d}" if iso else f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year}"


def email(value: str, key: bytes, undo: bool = False) -> str | None:
    host, _, top = value.rpartition(".")
    return permute_text(host, key, "email", undo) + "." + top


def secret(value: str, key: bytes, undo: bool = False) -> str | None:
    if len(value) < 8:
        return None
    fixed = "AKIA" if value.startswith("AKIA") else ""
    return fixed + permute_text(value[len(fixed):], key, "secret" + fixed, undo)


KINDS: dict[str, Callable[..., str | None]] = {"email": email, "iban": iban, "secret": secret, "machine": machine, "date": date,
                                              "social": social, "phone": phone, "card": card}
PATTERN = re.compile(r"""
  (?P<email>(?<![A-Za-z0-9_.+%-])[A-Za-z0-9_+%-][A-Za-z0-9_.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})
 |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
 |(?P<secret>(?:(?<=password=)|(?<=password:[ ])|(?<=token=)|(?<=token[ ]=[ ])|(?<=token=")|(?<=token[ ]=[ ]")|(?<=secret=)|(?<=api_key=))[A-Za-z0-9_~+/-]+(?:\.+[A-Za-z0-9_~+/-]+)*
   |(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9]))
 |(?P<machine>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))
 |(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9]))
 |(?P<social>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
 |(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])
   |(?<![0-9])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))
 |(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))
""", re.VERBOSE)
#: Every pattern needs one of these; most stretches of text have none.
HINT = re.compile(r"[0-9@=]|AKIA|password")


#: What a number in groups may consist of; values that could cut each other lie in one such run.
RUN = re.compile(r"[0-9A-Z .()+-]*")


class _Ends:
    """Where the value that begins at a place of one text ends (0: none begins there).

    Whether a value stands depends on those behind it, so a run is settled once from right to
    left: linear in its length, whatever the number of groups, and without recursion."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def __getitem__(self, at: int) -> int:
        if at not in self.known:
            places = [at]
            for q in range(at + 1, RUN.match(self.text, at).end() + 1):
                if self.text[q - 1] in " .-":
                    if q in self.known:
                        break
                    places.append(q)
            for q in reversed(places):
                found = _value(PATTERN.match(self.text, q), b"", self)
                self.known[q] = q + len(found[0]) if found else 0
        return self.known[at]


def _cuts(m: re.Match, end: int, ends: _Ends) -> bool:
    """Whether the first ``end`` characters of a match stop inside another value."""
    said, at = m[0], m.start()
    return any(said[i - 1] in " .-" and ends[at + i] > at + end for i in range(1, end))


def _beginnings(m: re.Match, ends: _Ends) -> Iterator[str]:
    """What of a match may be the value, best first: an IBAN of its country's length, the whole
    match, then its beginnings that stop before a separator, longest first; none that would
    cut the value behind it."""
    kind, said = m.lastgroup, m[0]
    length = IBAN_LENGTH.get(said[:2]) if kind == "iban" else None
    if length:
        places = [i for i, c in enumerate(said, 1) if c != " "]
        end = places[length - 1] if length <= len(places) else len(said)
        if end < len(said) and said[end] == " ":
            yield said[:end]
    if kind not in ("iban", "phone", "card") or not _cuts(m, len(said), ends):
        yield said
    if kind in ("phone", "card") or kind == "iban" and not length:
        for i in range(len(said) - 1, 0, -1):
            if said[i] in " .-" and (shorter := PATTERN.fullmatch(m.string, m.start(), m.start() + i)) and shorter.lastgroup == kind and not _cuts(m, i, ends):
                yield said[:i]


def _value(m: re.Match | None, key: bytes, ends: _Ends, undo: bool = False) -> tuple[str, str] | None:
    """The value at a match and its pseudonym; None if no beginning of the match holds its check."""
    for said in _beginnings(m, ends) if m else ():
        if (new := KINDS[m.lastgroup](said, key, undo)) is not None:
            return said, new
    return None


def pseudonymise_text(text: str, key: bytes, undo: bool = False) -> tuple[str, list[str]]:
    """The text with its private values replaced, and the kinds replaced in order.

    Behind the start of a match that holds no value the search goes on. A pseudonym beside
    rejected characters walks on until these would be rejected beside it too, so that it is
    found again and can be undone.
    """
    kinds: list[str] = []
    if not HINT.search(text):
        return text, kinds
    out, done, at = [], 0, 0
    rejected: list[tuple[int, int]] = []  # matches without a value that may reach into the next one
    ends = _Ends(text)
    while m := PATTERN.search(text, at):
        found = _value(m, key, ends, undo)
        if found is None:
            rejected.append(m.span())
            at = m.start() + 1
            continue
        said, new = found
        start, end, kind = m.start(), m.start() + len(said), m.lastgroup
        rejected = [(i, j) for i, j in rejected if j > start]
        if rejected or said != m[0]:
            low = max(0, min([start, *(i for i, _ in rejected)]) - 16)

            def told(new: str) -> bool:
                around = text[low:start] + new + text[end:end + 64]
                near = _Ends(around)
                again = PATTERN.match(around, start - low)
                own = _value(again, key, near)
                return own is not None and again.lastgroup == kind and own[0] == new and not any(_value(PATTERN.match(around, i - low), key, near) for i, _ in rejected)

            while told(said) and not told(new):
                new = KINDS[kind](new, key, undo)
        rejected.clear()
        kinds.append(kind)
        out += [text[done:start], new]
        done = at = end
    return "".join([*out, text[done:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", counts: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` pseudonymised, in place.

    With ``counts`` two more columns: ``n_values`` (values replaced) and ``kinds`` (their
    kinds, sorted and distinct, joined by a comma); columns of these names give way to them.
    Null text stays null, empty stays empty (both: no values). Values that fail their check
    (check digit, octet, calendar) are left as they are. Repeated rows stay, alike.
    """
    more = ["n_values", "kinds"] if counts else []
    kept = docs.drop(*more)
    schema = T.StructType([*kept.schema.fields] + ([T.StructField("n_values", T.IntegerType()), T.StructField("kinds", T.StringType())] if counts else []))

    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            got = [(None, []) if t is None else pseudonymise_text(t, key) for t in b["__text"]]
            b["__text"] = [t for t, _ in got]
            if counts:
                b["__n"], b["__kinds"] = [len(k) for _, k in got], [",".join(sorted(set(k))) for _, k in got]
            yield b

    # only id-like narrow columns and the text pass through Python; all keep their types
    inner = kept.select(*[F.col(c).alias("__text" if c == text_col else f"c{i}") for i, c in enumerate(kept.columns)])
    inner_schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner.columns, kept.schema.fields)]
                                + ([T.StructField("__n", T.IntegerType()), T.StructField("__kinds", T.StringType())] if counts else []))
    out = map_batches(inner, swap, inner_schema)
    return out.toDF(*schema.fieldNames())
