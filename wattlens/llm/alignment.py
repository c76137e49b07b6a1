"""Alignment of two tokenizers' ids over the same bytes, by lockstep vectorised merging.

A is a byte-level BPE vocabulary, B a SentencePiece model; both spell ``space + text``. Per
document two pointers walk over the token ends of A and B: the one whose token ends first goes
on, and where both end at one byte there is a cut, with a link between the two tokens that end
there. All documents of a batch walk at once: their pointers are one NumPy state vector, each
step advances every document, and documents that are through leave the vector. A long document
walks in several lanes, parted where an A token and a B token are known to end together, so
the number of steps does not follow its length.

A link's count is how many links of the whole corpus join its pair of ids. Counting is one
aggregation; its table comes back to the documents in pieces of bounded size, whose sums add up.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, split_evenly, store
from .encoder import _byte_letters

BATCH_CHARS = 1 << 20  # texts that walk at once, about
LANE = 512  # A tokens between the places where a long document may be parted
PAIRS_A_PIECE = 2_000_000  # rows of the pair table that are shipped at once (about 26 MB)
#: Fixed value: the splitting pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class ByteLevel:
    """Ids and token bytes of a byte-level BPE file. Special tokens in a text are plain text.

    Where the file's merges stand in the order of their ids, as they do in published files of
    this kind, ``tiktoken`` finds the same ids faster; any other file, and any text that it
    refuses, goes through the ``tokenizers`` library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        back = {c: b for b, c in _byte_letters().items()}
        vocab: dict[str, int] = said["model"]["vocab"]
        special = {x["content"]: x["id"] for x in said["added_tokens"]}
        size = 1 + max([*vocab.values(), *special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(back[c] for c in token)
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.fast = self._fast(said, {t: i for t, i in vocab.items() if t not in special})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def _fast(self, said: dict, vocab: dict[str, int]):
        pre = said.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in said["model"]["merges"]]
        ordered = all(vocab.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and said.get("normalizer") is None
        if not ordered or not plain or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except (ValueError, RuntimeError):
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Ids and token bytes of a SentencePiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    @cached_property
    def bytes(self) -> list[bytes]:
        out = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())
        return out

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.bytes], np.int64)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.library.encode(texts, num_threads=1)] if texts else []


@lru_cache(maxsize=2)
def _libraries(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


@lru_cache(maxsize=1)
def _words(size: int) -> list[str]:
    """Each id below ``size`` with what may follow it: a comma, a bar, a semicolon, nothing."""
    return [f"{i}{sign}" for i in range(size) for sign in (",", "|", ";", "")]


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, every: int = LANE):
    """Starts (A, B) and A stops of the lanes of documents whose A tokens are [a_from, a_to)."""
    inner = np.maximum((a_to - a_from - 1) // every, 0)
    first = np.repeat(np.cumsum(inner) - inner, inner)
    at = np.repeat(a_from, inner) + (np.arange(inner.sum()) - first + 1) * every
    ends = a_end[at - 1]
    place = np.searchsorted(b_end, ends)
    meet = b_end[np.minimum(place, len(b_end) - 1)] == ends if len(b_end) else np.zeros(len(at), bool)
    a = np.concatenate([a_from, at[meet]])
    b = np.concatenate([b_from, place[meet] + 1])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    lane_doc = np.searchsorted(a_from, a, side="right") - 1
    stop = np.append(a[1:], 0)
    last = np.append(lane_doc[1:] != lane_doc[:-1], True) if len(a) else np.zeros(0, bool)
    stop[last] = a_to[lane_doc[last]]
    return a, b, stop


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens that end together, in ascending order. ``a`` and ``b`` are the state: the
    next token of every lane; a lane is through when its A pointer has reached ``stop``."""
    met_a, met_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    alive = a < stop
    while True:
        if not alive.all():
            a, b, stop = a[alive], b[alive], stop[alive]
        if not len(a):
            break
        ends_a, ends_b = a_end[a], b_end[b]
        met = ends_a == ends_b
        met_a.append(a[met])
        met_b.append(b[met])
        a = a + (ends_a <= ends_b)
        b = b + (ends_b <= ends_a)
        alive = a < stop
    link_a, link_b = np.concatenate(met_a), np.concatenate(met_b)
    order = np.argsort(link_a)
    return link_a[order], link_b[order]


class Batch:
    """Tokens, cuts and links of some texts.

    ``na``, ``nb`` are tokens and ``nl`` links per text; ``a_ids``, ``b_ids`` the ids of all
    texts in a row; ``link_a``, ``link_b`` the places of linked tokens in these rows."""

    def __init__(self, texts: list[str | None], a_path: str, b_path: str):
        lib_a, lib_b = _libraries(a_path, b_path)
        self.size = max(len(lib_a.bytes), len(lib_b.bytes))
        spelled = [" " + t for t in texts if t]
        filled = np.array([bool(t) for t in texts], bool)
        ids_a = [lib_a.encode(t) for t in spelled]
        ids_b = lib_b.encode_all([t[1:] for t in spelled])
        same = [True] * len(spelled)
        whole = "".join(spelled).encode()
        for ids, table in ((ids_a, lib_a.bytes), (ids_b, lib_b.bytes)):
            if b"".join(map(table.__getitem__, (np.concatenate(ids) if ids else np.zeros(0, np.int64)).tolist())) != whole:
                same = [s and b"".join(map(table.__getitem__, x.tolist())) == t.encode() for s, x, t in zip(same, ids, spelled)]
        none = np.zeros(0, np.int64)
        kept_a = iter([x if s else none for x, s in zip(ids_a, same)])
        kept_b = iter([x if s else none for x, s in zip(ids_b, same)])
        rows_a = [next(kept_a) if f else none for f in filled]
        rows_b = [next(kept_b) if f else none for f in filled]
        self.na, self.nb = np.array([len(x) for x in rows_a], np.int64), np.array([len(x) for x in rows_b], np.int64)
        self.a_ids, self.b_ids = np.concatenate([none, *rows_a]), np.concatenate([none, *rows_b])
        a_end, b_end = np.cumsum(lib_a.lengths[self.a_ids]), np.cumsum(lib_b.lengths[self.b_ids])
        self.a_to, self.b_to = np.cumsum(self.na), np.cumsum(self.nb)
        some = self.na > 0
        starts = lanes(a_end, b_end, (self.a_to - self.na)[some], self.a_to[some], (self.b_to - self.nb)[some])
        self.link_a, self.link_b = lockstep(a_end, b_end, *starts)
        self.link_to = np.searchsorted(self.link_a, self.a_to)
        self.nl = np.diff(self.link_to, prepend=0)

    def keys(self, width: int) -> np.ndarray:
        """Linked pairs as one number each: A id x ``width`` + B id."""
        return self.a_ids[self.link_a] * width + self.b_ids[self.link_b]

    def groups(self) -> list[str]:
        """Per text ``a1,a2|b1;a3|b2,b3``: the ids between cuts; empty without tokens."""
        a_cut, b_cut = np.zeros(len(self.a_ids), bool), np.zeros(len(self.b_ids), bool)
        a_cut[self.link_a], b_cut[self.link_b] = True, True
        last = self.link_b[self.link_to[self.nl > 0] - 1]
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        b_before = np.concatenate([[0], self.link_b + 1])[a_group] if len(a_group) else a_group
        a_through = self.link_a[b_group] + 1 if len(b_group) else b_group
        signs = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)  # id x 4 + what follows it
        b_sign = np.where(b_cut, 2, 0)
        b_sign[last] = 3
        signs[np.arange(len(self.a_ids)) + b_before] = self.a_ids * 4 + a_cut
        signs[np.arange(len(self.b_ids)) + a_through] = self.b_ids * 4 + b_sign
        row = list(map(_words(self.size).__getitem__, signs.tolist()))
        to = (self.a_to + self.b_to).tolist()
        return ["".join(row[s:e]) for s, e in zip([0, *to[:-1]], to)]


def _found(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, width: int, texts_of_groups: bool) -> DataFrame:
    def run(frames):
        for f in frames:
            texts = [t if isinstance(t, str) else None for t in f["text"]]
            walk = np.cumsum([len(t or "") for t in texts]) // BATCH_CHARS
            starts = np.flatnonzero(np.diff(walk, prepend=-1)).tolist()
            for first, end in zip(starts, [*starts[1:], len(texts)]):
                made = Batch(texts[first:end], a_path, b_path)
                groups, keys = made.groups(), made.keys(width)
                out = pd.DataFrame({"id": f["id"].iloc[first:end].reset_index(drop=True), "n_a": made.na, "n_b": made.nb, "n_links": made.nl})
                out["groups_sha256"] = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
                out["groups"] = groups if texts_of_groups else None
                out["links"] = [keys[s:e] for s, e in zip((made.link_to - made.nl).tolist(), made.link_to.tolist())]
                del made, groups, keys
                yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(rows, run, f"id {id_kind}, n_a long, n_b long, n_links long, groups_sha256 string, groups string, links array<long>")


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """Rows (a_id, b_id, key, count, best) of every linked pair of ids in column ``links``;
    ``best``: no pair of that B id has a larger count."""
    counts = links.select(F.explode("links").alias("key")).groupBy("key").agg(F.count("*").alias("count")).select(
        F.expr(f"key div {width}").cast("int").alias("a_id"), F.expr(f"key % {width}").cast("int").alias("b_id"), "key", "count")
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "key", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(rows: DataFrame, pairs: DataFrame, kept: list[str]) -> DataFrame:
    """``rows`` with the sums over those of their links that stand in ``pairs`` (bounded)."""
    table = pairs.select("key", "count", "best").toArrow()  # at most about PAIRS_A_PIECE rows
    keys, counts, best = (table[c].to_numpy() for c in ("key", "count", "best"))
    order = np.argsort(keys)
    shipped = rows.sparkSession.sparkContext.broadcast((keys[order], counts[order].astype(np.int64), best[order].astype(np.int64)))

    def run(frames):
        keys, counts, best = shipped.value
        for f in frames:
            size = np.array([len(x) for x in f["links"]], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *f["links"]])
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            here = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            out = f[kept].copy()
            for name, value in (("n_best", best), ("count_sum", counts)):
                sums = np.concatenate([[0], np.cumsum(np.where(here, value[at], 0) if len(keys) else np.zeros(len(flat), np.int64))])
                ends = np.cumsum(size)
                out[name] = sums[ends] - sums[ends - size]
            yield out

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(rows.select(*kept, "links"), run, f"{schema}, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False,
          piece: int = PAIRS_A_PIECE) -> DataFrame:
    """One row per document: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256`` and, with ``groups``, the groups themselves.

    A text that is null or empty, or that either tokenizer does not spell byte by byte (control
    signs that B drops, U+2581), has no tokens: zeros and '' for the groups. Rows that repeat an
    id or a text are rows of their own and count each; null ids stay; an empty table gives an
    empty result; extra columns are ignored. ``id_col`` must not bear a result column's name.
    Very long texts are parted into lanes. ``piece`` bounds the pairs shipped at once.
    """
    if id_col in RESULT or id_col == "groups":
        raise ValueError(f"the id column is named like a result column: {id_col}")
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = store(_found(docs, a_path, b_path, id_col, text_col, width, groups).withColumn("row", F.monotonically_increasing_id()))
    pairs = store(pair_counts(rows, width))
    pieces = split_evenly(pairs.count(), piece)
    kept = ["id", "n_a", "n_b", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    if pieces == 1:
        scored = _scored(rows, pairs, kept)
    else:  # every piece gives its part of the sums
        parts = [_scored(rows, pairs.filter(F.pmod(F.hash("key"), F.lit(pieces)) == p), ["row"]) for p in range(pieces)]
        union = parts[0]
        for p in parts[1:]:
            union = union.union(p)
        sums = union.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        scored = rows.select("row", *kept).join(sums, "row")
    return scored.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum",
                         "groups_sha256", *(["groups"] if groups else []))
