"""Lines that repeat across documents, by two Bloom filters and an exact confirmation.

A line's key is the line without white space at its ends, A-Z lower-cased. Hashes of the keys
stream through two filters, dealt by hash ranges so that no task holds more than its range: a
hash that the first filter (seen once) already holds enters the second (seen twice). The second
filter is small, since only repeated keys are in it, and the lines are held against it where
they are read. Only lines that it suspects are shuffled: there the keys themselves are compared,
so a false suspicion changes nothing, and each repeated key finds its first document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, split_evenly, store

WHITE = "\t\n\x0b\x0c\r "
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANGE_KEYS = 1_000_000  # keys a hash range, about; one task holds one range at a time
ONCE_CELLS = 16  # cells of the first filter for each key that is expected in a range
TWICE_BITS = 12  # bits of the second filter for each hash that it holds
ROW_BITS = 1 << 13  # bits of one row of the second filter: all bits of one hash lie in one row
PROBES = 4
FILTER_BYTES = 64 << 20  # the second filter is never larger; a fuller one only suspects more lines
SALTS = 16


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), CAPITALS, SMALL)


def _lines(text: Column) -> Column:
    """All lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(docs: DataFrame, text: Column, least: int) -> DataFrame:
    """Per row the distinct hashes of the keys that count."""
    keys = F.filter(F.transform(_lines(text), line_key), lambda k: F.char_length(k) >= least)
    return docs.select(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k))).alias("h"))


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    """``PROBES`` cells of the first filter for each hash (rows)."""
    u = h.astype(np.uint64)
    step = (u >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((u * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i) * step) >> np.uint64(20)) % np.uint64(cells) for i in range(PROBES)], axis=1).astype(np.int64)


class TwoFilters:
    """The filters of one hash range. ``add`` takes hashes that are distinct within themselves
    and which of them were met more than once already; ``twice`` collects what the first filter
    held when it came again."""

    def __init__(self, keys: int):
        self.cells = max(1024, ONCE_CELLS * keys)
        self.once = np.zeros(self.cells, bool)
        self.twice: list[np.ndarray] = []

    def add(self, h: np.ndarray, again: np.ndarray) -> None:
        at = _cells(h, self.cells)
        seen = self.once[at].all(axis=1)
        self.once[at[~seen]] = True
        self.twice.append(h[seen | again])

    def repeated(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *self.twice]))


def _dealt(hashes: DataFrame, ranges: int, batch_keys: int = 1 << 20) -> DataFrame:
    """Rows (range, hashes, again): what a task met of each hash range, every hash once."""

    def run(frames):
        held: list[np.ndarray] = []
        size = 0

        def out():
            if not size:
                return
            h, n = np.unique(np.concatenate(held), return_counts=True)
            part = ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, n, part = h[order], n[order], part[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            yield pd.DataFrame({"part": part[at].astype(np.int32), "hashes": [x.tobytes() for x in np.split(h, at[1:])],
                                "again": [np.packbits(x > 1).tobytes() for x in np.split(n, at[1:])]})

        for f in frames:
            held += list(f["h"])
            size += sum(map(len, f["h"]))
            if size >= batch_keys:
                yield from out()
                held, size = [], 0
        yield from out()

    return map_batches(hashes, run, "part int, hashes binary, again binary")


def _row_of(h: np.ndarray, rows: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(rows) >> np.uint64(32)).astype(np.int64)


def twice_seen(docs: DataFrame, text: Column, least: int, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Hashes that the first filter held when they came again: rows (part, hashes binary)."""
    total = docs.agg(F.sum(F.size(_lines(text)))).first()[0] or 0
    ranges = split_evenly(total, range_keys)
    expected = split_evenly(total, ranges)
    dealt = _dealt(_hashes(docs, text, least), ranges)

    def run(frames):
        part, filters = None, None
        for f in frames:
            for p, h, again in zip(f["part"], f["hashes"], f["again"]):
                if p != part:
                    if filters is not None:
                        yield pd.DataFrame({"part": [part], "hashes": [filters.repeated().tobytes()]})
                    part, filters = p, TwoFilters(expected)
                h = np.frombuffer(h, np.int64)
                filters.add(h, np.unpackbits(np.frombuffer(again, np.uint8), count=len(h)).astype(bool))
        if filters is not None:
            yield pd.DataFrame({"part": [part], "hashes": [filters.repeated().tobytes()]})

    sorted_parts = dealt.repartition(max(1, min(ranges, 10_000)), "part").sortWithinPartitions("part")
    return map_batches(sorted_parts, run, "part int, hashes binary")


def second_filter(twice: DataFrame, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, int]:
    """The second filter as rows (place, words) and their number, of at most ``filter_bytes``."""
    entered = (twice.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
    rows = max(1, min(split_evenly(entered * TWICE_BITS, ROW_BITS), filter_bytes * 8 // ROW_BITS))

    def run(frames):
        for f in frames:
            for h in f["hashes"]:
                h = np.frombuffer(h, np.int64)
                row = _row_of(h, rows)
                places, local = np.unique(row, return_inverse=True)
                bits = np.zeros((len(places), ROW_BITS), bool)
                u = h.view(np.uint64)
                for i in range(PROBES - 1):  # the low 39 bits say which; the high 32 chose the row
                    bits[local, (u >> np.uint64(13 * i) & np.uint64(ROW_BITS - 1)).astype(np.int64)] = True
                words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                yield pd.DataFrame({"place": places.astype(np.int32), "words": list(words)})

    made = map_batches(twice, run, "place int, words array<long>")
    both = made.groupBy("place").agg(F.collect_list("words").alias("all"))  # a row at the border of hash ranges comes from each
    joined = F.aggregate(F.slice("all", 2, 1 << 30), F.col("all")[0], lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseOR(q)))
    return both.select("place", joined.alias("words")), rows


def suspected(lines: DataFrame, bits: DataFrame, rows: int) -> DataFrame:
    """Those of ``lines`` (column ``h``) whose hash the second filter holds; the filter is
    bounded by ``FILTER_BYTES``, so it is broadcast."""
    high = F.shiftrightunsigned("h", 32)
    place = F.shiftright(high * F.lit(rows).cast("long"), 32).cast("int")
    held = F.lit(True)
    for i in range(PROBES - 1):
        bit = F.shiftrightunsigned("h", 13 * i).bitwiseAND(F.lit(ROW_BITS - 1).cast("long")).cast("int")
        word = F.get("words", F.shiftright(bit, 6))
        held = held & (F.call_function("getbit", word, bit.bitwiseAND(F.lit(63))) == 1)
    return lines.withColumn("__place", place).join(F.broadcast(bits), (F.col("__place") == F.col("place")) & held, "left_semi").drop("__place")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Rows (id, mark, drop): the places (from 0) of the lines that a document loses.
    ``mark`` is a hash of the text; a document that loses nothing has no row."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bits, size = second_filter(store(twice_seen(rows, text, least)), filter_bytes)
    lines = rows.select("id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), F.posexplode(_lines(text)).alias("at", "line"))
    lines = lines.select("id", "mark", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least).withColumn("h", F.xxhash64("key"))
    # exact from here: a key may stand in a third of all documents, so it is dealt over salts
    who = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    s = store(suspected(lines, bits, size).drop("h").withColumn("salt", F.pmod(F.hash("id", "mark"), F.lit(SALTS))))
    part = s.groupBy("key", "salt").agg(F.min(who).alias("lo"), F.max(who).alias("hi"))
    firsts = part.groupBy("key").agg(F.min("lo").alias("first"), F.max("hi").alias("hi")).filter(F.col("first") != F.col("hi")).drop("hi")
    loses = part.join(firsts, "key").filter((F.col("lo") != F.col("first")) | (F.col("hi") != F.col("first"))).select("key", "salt", "first")
    lost = s.join(loses, ["key", "salt"]).filter(who != F.col("first"))
    return lost.groupBy("id", "mark").agg(F.collect_set("at").alias("drop"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` with the kept text in ``text_col`` and columns ``n_lines`` (before) and ``n_dropped``.

    Lines are parted at \\n. Keys of at least ``least`` code points that stand in two documents
    or more lose all their lines but those in the document with the smallest id that holds
    them, which keeps its own repeats. Rows of one id are one document; rows without an id are
    one document too, behind all others. A null or empty text has one empty line and its kept text
    is empty. Repeated rows, ties and very long texts need nothing special; an empty table
    gives an empty result; extra columns stay, but for those named ``n_lines`` or ``n_dropped``,
    which the result's columns replace.
    """
    extra = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    packed = docs.select(F.struct(*extra).alias("row")).select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(whole).alias("mark"))
    lost = dropped_lines(docs, id_col, text_col, least, filter_bytes).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "drop")
    both = packed.join(lost, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    parted = both.select("row", "drop", F.when(F.col("drop").isNotNull(), _lines(whole)).alias("lines"))  # only texts travel, their lines are parted behind the join
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get("lines", i))
    text = F.when(F.col("drop").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    count = F.char_length(whole) - F.char_length(F.translate(whole, "\n", "")) + 1
    return parted.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in extra], count.cast("long").alias("n_lines"),
                         F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
