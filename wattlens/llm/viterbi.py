"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is read once. For every position the search keeps the best way to reach it; only
positions within the longest piece are kept open. Whenever all surviving ways back from the
open positions meet in one boundary, the ids up to it are final and leave the window.

For unigram models the best way is the one with the largest sum of scores. Merge (BPE) models
define their result by merges; there a way may follow a piece u by a piece v only if merging
u v leaves both as they are, and exactly one way through such pairs reaches each
position, so the search has one survivor a position and gives the library's own ids. Characters
that no piece covers are spelled by byte pieces, or are unknown.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

SPACE = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMO = 300_000
SHORT = 48  # characters of a stretch that is remembered


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: numbers, 4 or 8 raw bytes, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at:at + size]
        at += size


class Model:
    """Pieces, scores, kinds and rules of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix, self.collapse, self.escape, self.rules = UNIGRAM, True, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                got = dict(_fields(value))
                self.rules = got.get(2, b"")
                self.prefix, self.collapse, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self._pairs: dict[tuple[int, int], bool] = {}
        # a stretch may be encoded by itself where no piece reaches across its first space mark
        self.across = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        if self.rules:
            raise ValueError("models with normalisation rules need the library's normaliser")

    def _step(self, parts: list[str]) -> list[str]:
        """One merge: the best-scored neighbours, left before right; the same list if there is none."""
        best, where = None, -1
        for i in range(len(parts) - 1):
            k = self.ids.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or self.scores[k] > best):
                best, where = self.scores[k], i
        return parts if where < 0 else [*parts[:where], parts[where] + parts[where + 1], *parts[where + 2:]]

    def merged(self, text: str) -> tuple[str, ...]:
        """A short text by the definition of merge models."""
        parts = list(text)
        while len(new := self._step(parts)) < len(parts):
            parts = new
        return tuple(parts)

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Which neighbours a piece can hold: a number for each character (0: in no piece of several
        characters), and a table of the numbers' pairs."""
        pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        known = {c: i for i, c in enumerate(sorted(set("".join(pairs))), 1)}
        letter, held = np.zeros(0x110000, np.int32), np.zeros((len(known) + 1, len(known) + 1), bool)
        letter[[ord(c) for c in known]] = list(known.values())
        for a, b in pairs:
            held[known[a], known[b]] = True
        return letter, held

    @cached_property
    def reach(self) -> dict[str, int]:
        """Length of the longest piece that ends with given two characters."""
        out: dict[str, int] = {}
        for p in self.ids:
            out[p[-2:]] = max(len(p), out.get(p[-2:], 0))
        return out

    @cached_property
    def halves(self) -> dict[str, tuple[str, ...]]:
        """The pieces that merging makes of their own characters, with the two parts that the last
        merge joins (characters: themselves)."""
        out: dict[str, tuple[str, ...]] = {}
        for p in self.ids:
            parts = list(p)
            while len(parts) > 2 and len(new := self._step(parts)) < len(parts):
                parts = new
            if len(parts) <= 2:  # the piece itself is what two parts make
                out[p] = tuple(parts)
        return out

    def follows(self, left: str, right: str) -> bool:
        """Whether merging ``left`` + ``right`` leaves them side by side.

        It does unless some merge across the border comes before the merges that made the two
        pieces. The border's neighbours in time are the right parts of ``left`` and the left
        parts of ``right``, so the later-made piece is undone step by step; what is left of a
        tie between equal scores merges first.
        """
        if right.startswith(SPACE) and not left.endswith(SPACE) and not self.across:
            return True
        key = (left, right)
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > MEMO:
                self._pairs.clear()
            got = self._pairs[key] = self._side_by_side(left, right)
        return got

    def _side_by_side(self, left: str, right: str) -> bool:
        score = lambda p: self.scores[self.ids[p]] if len(p) > 1 else float("inf")  # noqa: E731  characters are there from the start
        least, tie = float("-inf"), True  # a merge across comes in time if its score is above this, or equal where a tie goes to it
        while True:
            joined = self.ids.get(left + right)
            if joined is not None:
                s = self.scores[joined]
                if s > least or tie and s == least:
                    return False
            a, b = score(left), score(right)
            if a == b == float("inf"):
                return True
            if a < b:  # left was made last: before that its right part stood at the border
                least, tie, left = a, False, self.halves[left][1]
            else:
                least, tie, right = b, True, self.halves[right][0]


class Stream:
    """The search itself. ``feed`` takes characters and returns the pieces that are final."""

    def __init__(self, model: Model):
        self.m = model
        self.text = ""  # the window: characters after the committed boundary
        self.way: list[tuple[float, int, str] | None] = [(0.0, -1, "")]  # score, position before, piece
        self.widest, self.next = 0, 2 * model.longest

    def feed(self, chars: str) -> list[str]:
        out: list[str] = []
        for c in chars:
            self.text += c
            self.way.append(self._best(len(self.text)))
            if len(self.text) >= self.next:  # looked for now and then, which costs no more than the window's width
                self.widest = max(self.widest, len(self.text))
                out += self._commit()
                self.next = len(self.text) + self.m.longest
        return out

    def _best(self, at: int) -> tuple[float, int, str] | None:
        m, text, way, found = self.m, self.text, self.way, None
        if m.type == MERGES:
            for start in range(at - 1, max(-1, at - m.reach.get(text[max(0, at - 2):at], 1) - 1), -1):
                piece = text[start:at]
                if piece in m.halves or start == at - 1 and piece not in m.ids:
                    before = way[start]
                    if before is not None and (not before[2] or m.follows(before[2], piece)):
                        return 0.0, start, piece  # there is no other
            return None
        for size in range(1, min(m.longest, at) + 1):
            before = way[at - size]
            if before is None:
                continue
            piece = text[at - size:at]
            k = m.ids.get(piece)
            score = m.scores[k] if k is not None else m.least - 10.0 if size == 1 else None
            if score is not None and (found is None or before[0] + score > found[0]):
                found = (before[0] + score, at - size, piece)
        return found

    def _commit(self) -> list[str]:
        """Move the boundary to where all ways from the open positions meet."""
        n = len(self.text)
        live = {i for i in range(max(0, n - self.m.longest + 1), n + 1) if self.way[i] is not None}
        while len(live) > 1:  # the furthest position steps back until all are one
            i = max(live)
            live.discard(i)
            live.add(self.way[i][1])
        meet = live.pop() if live else 0
        if meet <= 0:
            return []
        pieces, i = [], meet
        while i > 0:
            pieces.append(self.way[i][2])
            i = self.way[i][1]
        base = self.way[meet][0]
        last = self.way[meet][2]
        self.text = self.text[meet:]
        self.way = [(0.0, -1, last), *[(w[0] - base, w[1] - meet, w[2]) if w is not None and w[1] >= meet else None for w in self.way[meet + 1:]]]
        return pieces[::-1]

    def finish(self) -> list[str]:
        pieces, i = [], len(self.text)
        while i > 0:
            pieces.append(self.way[i][2])
            i = self.way[i][1]
        self.text, self.way = "", [(0.0, -1, "")]
        return pieces[::-1]

    def resume(self, text: str, known: dict[str, list]) -> list[str]:
        """Pieces of a short stretch. The best way to a position depends on the characters before it
        only, so the search goes on behind the longest beginning that is ``known``, and tells
        there what it finds."""
        at = len(text)
        while at and text[:at] not in known:
            at -= 1
        self.text, self.way = text, known[text[:at]][:at + 1] if at else [(0.0, -1, "")]
        way = self.way
        for i in range(at + 1, len(text) + 1):
            way.append(self._best(i))
            known[text[:i]] = way  # shared: its first i + 1 entries
        return self.finish()


class Memo(dict):
    """Values by short text, made at need. Holds about ``most`` at a time: whenever half of them are
    new, those are dropped that were not asked for since the last time."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, text: str) -> bytes:
        got = self.older.get(text)
        if got is None:
            got = self.make(text)
        if len(text) <= SHORT:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[text] = got
        return got


class Codec:
    """Texts to ids and back. All ways meet wherever no piece holds both neighbours, as between
    words, so a text is cut there. The ids of a part are remembered, and new parts share the ways
    of common beginnings. The memos are bounded and longer parts are streamed."""

    def __init__(self, data: bytes):
        self.m = Model(data)
        self.memo = Memo(lambda text: self._packed(self._searched(text)), MEMO)
        self.alone = self.m.type == MERGES or bool(self.m.bytes)  # else unknown characters of two parts may share an id
        self.search = Stream(self.m)
        self.known: dict[str, list] = {}
        text = [p if k != CONTROL else "" for p, k in zip(self.m.pieces, self.m.kinds)]
        text[self.m.unknown:self.m.unknown + 1] = [" ⁇ "]
        self.spelled = [bytes([self.m.of_byte[i]]) if i in self.m.of_byte else t.encode() for i, t in enumerate(text)]
        self.control = np.array([k == CONTROL for k in self.m.kinds], bool)

    def normal(self, text: str) -> str:
        m = self.m
        if m.collapse:
            text = " ".join(filter(None, text.split(" ")))
        if m.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if m.escape else text

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            k = self.m.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.m.bytes:
                out += [self.m.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.m.unknown or self.m.type == MERGES:
                out.append(self.m.unknown)
        return out

    def _packed(self, pieces: list[str]) -> bytes:
        ids = self._ids(pieces)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _searched(self, part: str) -> list[str]:
        """The pieces of a part that no piece reaches across."""
        if len(part) > SHORT:
            s = Stream(self.m)
            return s.feed(part) + s.finish()
        if len(self.known) >= MEMO:
            self.known.clear()
        return self.search.resume(part, self.known)

    def _parts(self, text: str) -> list[str]:
        letter, held = self.m.neighbours
        of = letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        cuts = (np.flatnonzero(~held[of[:-1], of[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]

    def _stretches(self, text: str) -> list[str]:
        """From one space mark to the next; runs of marks belong to the stretch that they open."""
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        text = self.normal(text)
        if self.alone:
            return np.frombuffer(b"".join(map(self.memo.__getitem__, self._parts(text))), "<u4")
        stretches = [text] if self.m.across else self._stretches(text)
        return np.frombuffer(b"".join(self._packed([x for part in self._parts(t) for x in self._searched(part)]) for t in stretches), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text, without the space that encoding puts before it."""
        runs = np.split(ids, np.flatnonzero(self.control[ids])) if self.control[ids].any() else [ids]  # no character reaches across a control id
        text = "".join(b"".join(map(self.spelled.__getitem__, run.tolist())).decode("utf-8", "replace") for run in runs)
        if self.m.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    key = zlib.crc32(data)
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, its ids (array) and the text decoded from them.

    Null and empty texts have no ids and decode to an empty text. Repeated rows repeat. Empty
    table: no rows. Other columns are neither read nor returned. The model file is read on
    the driver and travels with the job.
    """
    with open(model_file, "rb") as f:
        told = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(told.value)
        for b in batches:
            ids = [c.encode(t if isinstance(t, str) else None) for t in b["text"]]
            yield pd.DataFrame({id_col: b["id"], "ids": [x.astype(np.int32) for x in ids], "decoded": [c.decode(x) for x in ids]})

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """n_ids, ids_crc32 (ids as little-endian unsigned 32-bit numbers) and decoded_crc32 instead of the values."""
    kept = [c for c in encoded.columns if c not in ("ids", "decoded")]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept) + ", n_ids long, ids_crc32 long, decoded_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[kept].assign(n_ids=[len(x) for x in b["ids"]], ids_crc32=[zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in b["ids"]],
                                 decoded_crc32=[zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in b["decoded"]])

    return map_batches(encoded, run, schema)
