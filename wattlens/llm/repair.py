"""Token files with Re-Pair grammar compression.

A shard holds the ids of consecutive documents. Frequent pairs of neighbours are replaced by
nonterminals, again and again, while pairs occur 8 times or more and ids below 2^16 are free (below
2^32 for a vocabulary that leaves none of 16 bits). The file keeps
the rules, their expansion lengths, the remaining sequence and the documents' bounds, so
that any document is decoded without its neighbours.

File format (little-endian): ``RPR1``, base, rules, symbols, documents (unsigned 32-bit), width
of a symbol in bytes (32-bit), then rules as pairs of symbols, expansion length of each rule
(32-bit), sequence, and the end of every document in ids (64-bit).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import in_ranges, map_batches, store
from .encoder import encoder

MAGIC = b"RPR1"
SHARD_IDS = 1 << 20


def compress(ids: np.ndarray, base: int, least: int = 8, each_round: int = 4096, symbols: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols) and remaining sequence. Every round takes the most frequent
    pairs, at most ``each_round``, that occur ``least`` times or more; overlapping places go
    to the left one. Rounds end when no such pair or no free symbol is left."""
    seq = ids.astype(np.uint64)
    rules: list[np.ndarray] = []
    free = symbols - base
    while len(seq) > 1 and free > 0:
        pair = seq[:-1] << np.uint64(32) | seq[1:]
        ordered = np.sort(pair)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(ordered)]]))
        often = np.flatnonzero(counts >= least)
        room = min(free, each_round)
        if len(often) > room:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:room]])
        if not len(often):
            break
        chosen = ordered[starts[often]]
        # places by a hash table; of chosen pairs that share a slot one waits for the next round
        slot = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        at_slot = np.full(1 << 20, -1, np.int32)
        at_slot[(chosen * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)] = np.arange(len(chosen), dtype=np.int32)
        which = at_slot[slot]
        places = np.flatnonzero(which >= 0)
        which = which[places]
        exact = chosen[which] == pair[places]
        places, which = places[exact], which[exact]
        fresh = np.concatenate([[True], np.diff(places) != 1])  # of a run of neighbouring places every other one is taken
        in_run = np.arange(len(places)) - np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
        take = in_run % 2 == 0
        uses = np.bincount(which[take], minlength=len(chosen))
        take &= (uses >= 2)[which]
        kept = np.flatnonzero(uses >= 2)
        if not len(kept):
            break
        name = np.zeros(len(chosen), np.uint64)
        done = sum(map(len, rules))
        name[kept] = base + done + np.arange(len(kept))
        seq[places[take]] = name[which[take]]
        stay = np.ones(len(seq), bool)
        stay[places[take] + 1] = False
        seq = seq[stay]
        rules.append(np.stack([chosen[kept] >> np.uint64(32), chosen[kept] & np.uint64(0xFFFFFFFF)], axis=1))
        free -= len(kept)
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.uint64)).astype(np.uint32), seq.astype(np.uint32)


def expansions(rules: np.ndarray, base: int) -> list[np.ndarray]:
    """Ids of every rule; a rule names only earlier ones."""
    out: list[np.ndarray] = []
    for left, right in rules.tolist():
        out.append(np.concatenate([out[s - base] if s >= base else np.array([s], np.uint32) for s in (left, right)]))
    return out


def to_file(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    rules, seq = compress(ids, base, symbols=1 << 16 if base < 1 << 16 else 1 << 32)
    length = np.ones(base + len(rules), np.int64)
    for i, (left, right) in enumerate(rules.tolist()):
        length[base + i] = length[left] + length[right]
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    head = struct.pack("<5I", base, len(rules), len(seq), len(ends), int(kind[2]))
    return b"".join([MAGIC, head, rules.astype(kind).tobytes(), length[base:].astype("<u4").tobytes(), seq.astype(kind).tobytes(), ends.astype("<u8").tobytes()])


class Shard:
    """A file opened for reading: ``document(i)`` decodes one document, ``ids()`` all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.base, rules, symbols, documents, width = struct.unpack("<5I", data[4:24])
        at, parts = 24, []
        for count, kind in ((2 * rules, f"<u{width}"), (rules, "<u4"), (symbols, f"<u{width}"), (documents, "<u8")):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.rules, self.rule_length, self.seq, self.ends = parts[0].reshape(-1, 2), parts[1], parts[2], parts[3].astype(np.int64)
        length = np.concatenate([np.ones(self.base, np.int64), self.rule_length.astype(np.int64)])
        self.upto = np.cumsum(length[self.seq])

    def ids(self) -> np.ndarray:
        flat = np.concatenate([np.arange(self.base, dtype=np.uint32), *expansions(self.rules, self.base)])
        length = np.concatenate([np.ones(self.base, np.int64), self.rule_length.astype(np.int64)])
        first = np.cumsum(length) - length
        each = length[self.seq]
        return flat[np.repeat(first[self.seq] - (self.upto - each), each) + np.arange(self.upto[-1] if len(self.upto) else 0)]

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1, expanding only the symbols that cover them and, in those, only
        the rules that reach into the span."""
        out: list[int] = []
        i = int(np.searchsorted(self.upto, start, side="right"))
        at = int(self.upto[i - 1]) if i else 0
        while at < end and i < len(self.seq):
            stack = [int(self.seq[i])]
            while stack and at < end:
                s = stack.pop()
                n = 1 if s < self.base else int(self.rule_length[s - self.base])
                if at + n <= start:
                    at += n
                elif s < self.base:
                    out.append(s)
                    at += 1
                else:
                    stack += [int(self.rules[s - self.base][1]), int(self.rules[s - self.base][0])]
            i += 1
        return np.array(out, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Files (range, shard, ids array, n_tokens, data) of all documents in ascending id order.

    Shards of a range follow each other, ranges too. A shard is closed at ``shard_ids`` ids or at
    the end of its range; a longer document has a shard of its own. Null and empty texts are
    the end id alone. Null ids come first, repeated rows follow each other, an empty table
    has no shards. The files are rows of a Parquet table in the shared folder, so that they
    can lie in any store and survive lost executors.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        base = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        at, number, names, held, size = None, 0, [], [], 0

        def close() -> Iterator[pd.DataFrame]:
            nonlocal names, held, size, number
            if names:
                ends = np.cumsum([len(x) for x in held])
                yield pd.DataFrame({"range": [at], "shard": [number], "ids": [names], "n_tokens": [int(ends[-1])], "data": [to_file(np.concatenate(held), ends, base)]})
                names, held, size, number = [], [], 0, number + 1

        for b in batches:
            b = b[b["copy"] == 0]
            for r, k, ids in zip(b["range"], b["id"], enc.encode_batch(b["text"].tolist())):
                if r != at or size >= shard_ids:
                    yield from close()
                    at, number = r, number if r == at else 0
                names.append(None if pd.isna(k) else k)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
        yield from close()

    return store(map_batches(in_ranges(docs, id_col, text_col), build, f"range int, shard int, ids array<{kind}>, n_tokens long, data binary"))


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start (ids before it), n_tokens, ids_crc32 and tokens."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = shards.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("range", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("in_range")).join(ranges, "range").select(
        "range", "shard", (F.col("range_start") + F.col("in_range")).alias("first"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, s, names, data in zip(b["range"], b["shard"], b["ids"], b["data"]):
                shard = Shard(data)
                ids = shard.ids().astype("<u4")
                begin = np.concatenate([[0], shard.ends[:-1]])
                parts = [ids[x:y] for x, y in zip(begin.tolist(), shard.ends.tolist())]
                yield pd.DataFrame({"range": r, "shard": s, id_col: pd.Series(list(names), dtype=object), "at": begin, "n_tokens": shard.ends - begin,
                                    "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts]})

    rows = map_batches(shards.select("range", "shard", "ids", "data"), read, f"range int, shard int, `{id_col}` {kind}, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["range", "shard"]).select(id_col, (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
