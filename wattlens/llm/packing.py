"""Best-fit packing of token pieces under several capacities at once.

A piece's vector (tokens, documents, attention cost) follows from its length alone, so a
corpus is fully described by how many pieces it has of each length: at most ``capacity``
numbers. Vector best-fit decreasing runs over those classes; open sequences with the same
residual vector are one class too. The result is a plan of runs "pieces i to j of this length
go to sequences s to t at this offset", whose size depends on the capacity and not on the
corpus. Every piece then finds its place by its length and its number within the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import gapless, map_batches, store
from .encoder import encoder


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids, with the end id, cut into pieces of ``capacity``: (id, piece, start, length, ids_crc32)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        for b in batches:
            rows: list[tuple] = []
            for k, ids in zip(b["__id"], enc.encode_batch(b["__text"].tolist())):
                ids = np.concatenate([ids, end])
                for n, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s:s + capacity]
                    rows.append((k, n, s, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), cut,
                       f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int, documents: int | None = None, attention: int | None = None, rule: str = "dot") -> list[tuple]:
    """Runs (length, first number, count, first sequence, offset) of vector best-fit decreasing.

    ``counts``: pieces of each length. ``documents``: most pieces in a sequence; ``attention``:
    most cost, the sum of squared lengths; None leaves a capacity as wide as the tokens
    allow. ``rule``: "dot" takes the open sequences with the largest dot product of the
    piece's vector and the used share of each capacity (the fullest along the piece's
    direction), "norm" those with the smallest residual norm after placing.
    """
    most = np.array([capacity, documents or capacity, attention or capacity * capacity], float)
    open_: dict[tuple[int, int, int], list[list[int]]] = {}  # residual vector -> runs [first sequence, count]
    made, out = 0, []
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        need, left, number = (length, 1, length * length), counts[length], 0
        if length > capacity or need[2] > most[2]:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        per = need / most
        while left:
            states = np.array([s for s in open_ if all(a >= b for a, b in zip(s, need))], float).reshape(-1, 3)
            if len(states):
                score = (1 - states / most) @ per if rule == "dot" else -np.linalg.norm((states - need) / most, axis=1)
                best = tuple(int(x) for x in states[np.lexsort((states[:, 2], states[:, 1], states[:, 0], -score))[0]])
                first, n = open_[best].pop()
                if not open_[best]:
                    del open_[best]
            else:  # as many new sequences as full ones of this length alone need
                best = tuple(int(x) for x in most)
                each = min(b // n for b, n in zip(best, need))
                first, n = made, -(-left // each)
                made += n
            take = min(n, left)
            if take < n:
                open_.setdefault(best, []).append([first + take, n - take])
            out.append((length, number, take, first, capacity - best[0]))
            open_.setdefault(tuple(b - x for b, x in zip(best, need)), []).append([first, take])
            number, left = number + take, left - take
    return out


def pack(parts: DataFrame, capacity: int = 2048, documents: int | None = None, attention: int | None = None, rule: str = "dot",
         id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces. Offsets are gapless from 0 within a sequence.

    Ties (pieces of one length) are ordered by id, piece and checksum. Repeated documents are
    packed as often as they occur. Empty table: no rows. Null id: packed as any other.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity, documents, attention, rule)
    numbered = gapless(parts, ["length"], [F.col(id_col), F.col("piece"), F.col("ids_crc32")], "__number")
    by_length: dict[int, list[tuple]] = {}
    for length, number, count, first, offset in runs:
        by_length.setdefault(length, []).append((number, number + count, first, offset))
    table = spark.createDataFrame(list(by_length.items()), "length long, runs array<struct<a:long,b:long,first:long,offset:long>>")
    found = numbered.join(F.broadcast(table), "length", "left")  # at most ``capacity`` rows
    run = F.get(F.filter("runs", lambda r: (r["a"] <= F.col("__number")) & (F.col("__number") < r["b"])), F.lit(0))
    return found.withColumn("__run", run).select(
        *parts.columns, (F.col("__run.first") + F.col("__number") - F.col("__run.a")).alias("sequence_id"), F.col("__run.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Tokenise, cut and pack. Null and empty texts are the end id alone, one piece of length 1."""
    return pack(store(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity, id_col=id_col, **limits)
