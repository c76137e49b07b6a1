"""Document fingerprints from prefix polynomial hashes.

The array of a text's prefix hashes, modulo two primes, answers whether any two spans are
equal in constant time and how far two texts agree from given places by binary search. A
fingerprint keeps, in bounded size, prefix and suffix hashes at lengths of a geometric
grid, the hash of the whole text and the least hashes of all windows; two fingerprints tell
how alike their texts are.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import in_ranges, map_batches

PRIMES = (2147483647, 2147483629)
BASES = (1103515245 % PRIMES[0], 1664525 % PRIMES[1])
WINDOW, LEAST = 24, 32
#: Lengths at which prefixes and suffixes are compared: half powers of two, up to 2^31 code points.
GRID = np.unique([int(2 ** (k / 2)) for k in range(63)])

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(i: int, n: int, inverse: bool = False) -> np.ndarray:
    """BASES[i] ** 0 .. n - 1 modulo PRIMES[i], or of its inverse; grown by doubling and kept."""
    p = _powers.get((i, inverse), np.ones(1, np.uint64))
    while len(p) < n:
        step = np.uint64(pow(BASES[i], -len(p) if inverse else len(p), PRIMES[i]))
        p = np.concatenate([p, p * step % np.uint64(PRIMES[i])])
    _powers[i, inverse] = p
    return p[:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def least_distinct(values: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` least distinct values, ascending; all, if there are fewer."""
    reach = 2 * count
    while 2 * reach < len(values):
        found = np.unique(np.partition(values, reach)[:reach])
        if len(found) >= count:
            return found[:count]
        reach *= 8  # repeats fill the places so far
    return np.unique(values)[:count]


class PrefixHash:
    """Prefix hashes h[i] = sum of c[j] B^j for j < i, modulo each prime."""

    def __init__(self, code: np.ndarray, begin: PrefixHash | None = None, keep: int = 0):
        """Of the codes; or of the first ``keep`` of ``begin`` with the codes after them."""
        self.n = keep + len(code)
        self.h = []
        for i, p in enumerate(PRIMES):
            mod = np.uint64(p)
            terms = code * powers(i, self.n)[keep:] % mod  # below 2^31, so 2^33 of them fit a sum
            old = begin.h[i][:keep + 1] if begin is not None else np.zeros(1, np.uint64)
            self.h.append(np.concatenate([old, (old[-1] + np.cumsum(terms)) % mod]))

    def spans(self, starts: np.ndarray, ends: np.ndarray, i: int) -> np.ndarray:
        """Hashes of spans modulo one prime, the same wherever a span stands."""
        mod, h = np.uint64(PRIMES[i]), self.h[i]
        return (h[ends] + (mod - h[starts])) % mod * powers(i, self.n + 1, inverse=True)[starts] % mod

    def span(self, start: int, end: int) -> tuple[int, int]:
        at, to = np.array([start]), np.array([end])
        return int(self.spans(at, to, 0)[0]), int(self.spans(at, to, 1)[0])

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common span that begins at the two places."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, other_start, mid) else (low, mid - 1)
        return low

    def windows(self, width: int) -> np.ndarray:
        """Mixed hashes of all windows of ``width`` (of the whole, if shorter)."""
        width = min(width, self.n)
        if not width:
            return np.empty(0, np.uint32)
        mod, h, count = np.uint64(PRIMES[0]), self.h[0], self.n - width + 1
        w = (h[width:] + (mod - h[:count])) % mod * powers(0, count, inverse=True) % mod
        return ((w + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self) -> str:
        """Length, whole hash, prefix and suffix hashes on the grid, least window hashes; base64."""
        grid = GRID[GRID <= self.n]
        zero, full = np.zeros(len(grid), np.int64), np.full(len(grid), self.n)
        ends = [(self.spans(a, b, 0) * np.uint64(31) + self.spans(a, b, 1)).astype("<u4") for a, b in ((zero, grid), (full - grid, full))]
        least = least_distinct(self.windows(WINDOW), LEAST).astype("<u4")
        return base64.b64encode(struct.pack("<QII", self.n, *self.span(0, self.n)) + ends[0].tobytes() + ends[1].tobytes() + least.tobytes()).decode()


def likeness(one: str, two: str) -> float:
    """0 to 1, from two fingerprints alone: 1 for equal texts; else the larger of the windows'
    estimated resemblance and the share of the longer text that agrees at the two ends."""
    if one == two:
        return 1.0
    parts = []
    for said in (one, two):
        raw = base64.b64decode(said)
        n = struct.unpack("<Q", raw[:8])[0]
        k = int(np.searchsorted(GRID, n, side="right"))
        v = np.frombuffer(raw[16:], "<u4")
        parts.append((n, v[:k], v[k:2 * k], v[2 * k:]))
    (n, head, tail, least), (m, other_head, other_tail, other_least) = parts
    if not n or not m:
        return 0.0
    union = np.union1d(least, other_least)[:LEAST]
    alike = len(np.intersect1d(np.intersect1d(least, other_least), union)) / len(union)

    def agree(a: np.ndarray, b: np.ndarray) -> int:
        low, high = 0, min(len(a), len(b))  # agreement at a length implies it at all shorter ones
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
        return int(GRID[low - 1]) if low else 0

    ends = min(agree(head, other_head) + agree(tail, other_tail), n, m) / max(n, m)
    return float(min(max(alike, ends), 1 - 1 / (1 + max(n, m))))


def fingerprint(text: str | None) -> str:
    return PrefixHash(codes(text or "")).fingerprint()


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in ascending id order.

    The edited text: the last floor(n / 2) code points are replaced by the first as many (or
    all) of the next document; the last document's next is the first, a sole document's is
    itself. Null text: as empty. Null ids come first; rows with one id are ordered by a hash of
    their text. Repeated rows follow each other. Empty table: no rows.
    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = in_ranges(docs, id_col, text_col)

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (range, id, text, hash, fingerprint) of the row before
        for b in batches:
            out = []
            for at, copy, k, t in zip(b["range"], b["copy"], b["id"], b["text"]):
                code = codes(t)
                own = PrefixHash(code)
                now = (at, copy, k, code, own, own.fingerprint())
                if last is not None and last[0] == at:
                    out.append(_edited(last, now))
                last = None if copy else now
            yield pd.DataFrame(out, columns=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return map_batches(rows, edit, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edited(one: tuple, following: tuple) -> tuple:
    _, _, k, code, own, said = one
    keep = len(code) - len(code) // 2
    tail = following[3][:len(code) - keep]
    text = np.concatenate([code[:keep], tail])
    new = PrefixHash(tail, own, keep)
    digest = sha256((text - np.uint64(1)).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    fresh = new.fingerprint()
    return k, len(code), digest, said, fresh, likeness(said, fresh), likeness(said, following[5])
