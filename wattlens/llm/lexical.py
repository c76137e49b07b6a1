"""Ranked lexical search over a length-stratified index.

Documents of one length normaliser ``m`` form a stratum. A stratum's postings are grouped by
(term, tf), so the impact of a tf is computed once for all documents that share it. The largest
tf of each term bounds what any document of a stratum can score for an item: every item visits
its strata from the highest bound, and after the first few of them only those whose bound reaches
the score of its k-th document so far. All sums are 64-bit integers, so nothing depends on order.

A stated set of items is searched in blocks of bounded size; what is shipped to the workers is
one block's terms. Large strata are dealt over parts of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_batches, split_evenly, store

ITEM_BYTES = 8 << 20  # text of the items that are searched in one block
PART_POSTINGS = 1 << 19  # postings of a part of a stratum, about
FIRST_DOCS = 1_000  # documents in the strata that an item visits first
SHIPPED_ROWS = 4_000_000  # visits or strata up to which they are broadcast
CELLS = 1 << 21  # scores that a worker holds at once

#: ASCII letters (small ones) and digits stay, other ASCII becomes a space, all other bytes stay.
SIGNS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all signs beyond ASCII; only A-Z are
    lower-cased. Bytes of UTF-8: a sign beyond ASCII has no byte below 128."""
    return text.encode("utf-8", "replace").translate(SIGNS).split(b" ") if text else []


def _counted(text) -> tuple[int, Counter]:
    found = Counter(terms_of(text if isinstance(text, str) else None))
    found.pop(b"", None)
    return sum(found.values()), found


def normaliser(n, documents: int, length: int) -> int:
    return 100 - 25 + (25 * n * documents) // length


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Items:
    """One block of items: their terms, and per item (term, times) in a row of arrays."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        counts = [_counted(t)[1] for _, t in rows]
        for c in counts:
            for t in c:
                self.vocabulary.setdefault(t, len(self.vocabulary))
        self.item = np.repeat(np.arange(len(rows)), [len(c) for c in counts])
        self.term = np.array([self.vocabulary[t] for c in counts for t in c], np.int64)
        self.times = np.array([x for c in counts for x in c.values()], np.int64)

    def weighted(self, weights: np.ndarray):
        """(first place of each item and the end, terms, times x weight)."""
        start = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        return start, self.term, self.times * weights[self.term]


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document its id, the number of all its terms and (term, tf) of those in ``vocabulary``."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames):
        known = shipped.value
        for f in frames:
            n, terms, tfs = [], [], []
            for text in f["text"]:
                size, found = _counted(text)
                hits = known.keys() & found.keys()
                n.append(size)
                terms.append(np.fromiter(map(known.__getitem__, hits), np.int32, len(hits)))
                tfs.append(np.fromiter(map(found.__getitem__, hits), np.int64, len(hits)))
            yield pd.DataFrame({"id": f["id"], "n": n, "terms": terms, "tfs": tfs})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n long, terms array<int>, tfs array<long>")


def stratified(rows: DataFrame, documents: int, length: int, part_postings: int = PART_POSTINGS) -> DataFrame:
    """The index: a row per stratum ``m`` and part, with the ids in order, and the postings as
    groups (``g_term``, ``g_tf``, ``g_to``) of document places."""
    known = rows.filter(F.size("terms") > 0).withColumn("m", F.expr(f"75L + (25L * n * {documents}L) div {length}L"))
    strata = known.groupBy("m").agg(F.sum(F.size("terms")).alias("postings"))
    wide = store(strata.withColumn("parts", F.ceil(F.col("postings") / F.lit(part_postings)).cast("int")).filter("parts > 1").drop("postings"))
    small = F.broadcast(wide) if wide.count() <= SHIPPED_ROWS else wide
    dealt = known.join(small, "m", "left").withColumn("part", F.pmod(F.hash("id", "n", "terms"), F.coalesce("parts", F.lit(1)))).drop("parts")
    kind = rows.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(f"m long, part int, docs int, ids array<{kind}>, g_term array<int>, g_tf array<long>, g_to array<int>, places array<int>")
    arrow = to_arrow_schema(schema)

    def build(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
        terms, tfs = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
        size = np.diff(terms.offsets.to_numpy())
        term, tf = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.lexsort((place, tf, term))
        term, tf, place = term[order], tf[order], place[order]
        new = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(tf) != 0)))
        row = {"m": t["m"][0].as_py(), "part": t["part"][0].as_py(), "docs": len(size), "ids": t["id"].combine_chunks(), "g_term": term[new], "g_tf": tf[new],
               "g_to": np.append(new[1:], len(term)), "places": place}
        columns = [pa.ListArray.from_arrays(pa.array([0, len(row[f.name])], pa.int32()), pa.array(row[f.name], f.type.value_type) if f.name != "ids" else row["ids"].cast(f.type.value_type))
                   if pa.types.is_list(f.type) else pa.array([row[f.name]], f.type) for f in arrow]
        return pa.Table.from_arrays(columns, names=arrow.names)

    return dealt.groupBy("m", "part").applyInArrow(build, schema)


def bounds(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (item, m, bound, docs): no document of stratum ``m`` scores more for ``item``.
    ``entries``: (item, term, weighted) of one block of items."""
    groups = index.select("m", F.explode(F.arrays_zip("g_term", "g_tf")).alias("g")).groupBy("m", F.col("g.g_term").alias("term")).agg(F.max("g.g_tf").alias("tf"))
    impact = F.expr("weighted * ((1000000000L * tf) div (1000L * tf + 12L * m))")
    sums = groups.join(F.broadcast(entries), "term").groupBy("item", "m").agg(F.sum(impact).alias("bound"))
    return sums.join(index.groupBy("m").agg(F.sum("docs").alias("docs")), "m")


def _best(scores: np.ndarray, floor: int, k: int) -> np.ndarray:
    """Places of the ``k`` best scores from ``floor`` on, best first, equal ones in place order."""
    at = np.flatnonzero(scores >= floor)
    if len(at) > 4 * k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def visit(index: DataFrame, visits: DataFrame, shipped, k: int) -> DataFrame:
    """Rows (item, id, score): the best documents of each task for each item, from those strata
    that ``visits`` (item, m, floor) names. ``shipped``: the block's items, weighted."""
    lists = visits.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("item", "floor"))).alias("v")).select("m", "v.item", "v.floor")
    lists = F.broadcast(lists) if visits.count() <= SHIPPED_ROWS else lists
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(frames):
        start, q_term, q_weight = shipped.value
        best: dict[int, list] = {}  # at most 2 k entries an item

        def cut(item: int) -> None:
            best[item].sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
            del best[item][k:]

        for f in frames:
            for m, docs, ids, g_term, g_tf, g_to, places, items, floors in zip(*(f[c] for c in ("m", "docs", "ids", "g_term", "g_tf", "g_to", "places", "item", "floor"))):
                g_tf, g_to = np.asarray(g_tf, np.int64), np.asarray(g_to, np.int64)
                impact = np.repeat(1_000_000_000 * g_tf // (1000 * g_tf + 12 * int(m)), np.diff(g_to, prepend=0))  # once per (term, tf)
                distinct, first = np.unique(g_term, return_index=True)
                term_from = np.concatenate([[0], g_to])[first]
                term_to = np.append(term_from[1:], len(places))
                step = max(1, CELLS // int(docs))
                for s in range(0, len(items), step):
                    some = np.asarray(items[s:s + step], np.int64)
                    entries = start[some + 1] - start[some]
                    e = np.repeat(start[some] - (np.cumsum(entries) - entries), entries) + np.arange(entries.sum())
                    owner = np.repeat(np.arange(len(some)), entries)
                    at = np.minimum(np.searchsorted(distinct, q_term[e]), len(distinct) - 1)
                    there = distinct[at] == q_term[e]
                    e, owner, at = e[there], owner[there], at[there]
                    size = term_to[at] - term_from[at]
                    acc = np.zeros(len(some) * int(docs), np.int64)
                    ends = np.cumsum(size)
                    at_entry = 0
                    while at_entry < len(e):  # some million postings at a time
                        upto = max(at_entry + 1, int(np.searchsorted(ends, (ends[at_entry - 1] if at_entry else 0) + 2 * CELLS, side="right")))
                        sl = slice(at_entry, upto)
                        z = size[sl]
                        p = np.repeat(term_from[at[sl]] - (np.cumsum(z) - z), z) + np.arange(z.sum())
                        np.add.at(acc, np.repeat(owner[sl] * int(docs), z) + places[p], np.repeat(q_weight[e[sl]], z) * impact[p])
                        at_entry = upto
                    for item, scores, floor in zip(some.tolist(), acc.reshape(len(some), int(docs)), floors[s:s + step]):
                        held = best.setdefault(item, [])
                        least = max(1, int(floor), held[k - 1][0] if len(held) >= k else 0)
                        found = _best(scores, least, k)
                        if len(found):
                            held += [(int(scores[x]), ids[x]) for x in found]
                            cut(item)
        flat = [(i, d, s) for i, held in best.items() for s, d in held]
        if flat:
            yield pd.DataFrame({"item": [x[0] for x in flat], "id": pd.Series([x[1] for x in flat], dtype=object), "score": [x[2] for x in flat]})

    return map_batches(index.join(lists, "m"), run, f"item int, id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    rows = store(forward(docs, items.vocabulary, id_col, text_col))
    documents, length = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not documents or not items.vocabulary:
        return None
    df = np.zeros(len(items.vocabulary), np.int64)
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most one row a term of the block
    df[held["term"].to_numpy()] = held["count"].to_numpy()
    weighted = items.weighted(np.array([weight(documents, int(x)) for x in df], np.int64))
    shipped = spark.sparkContext.broadcast(weighted)
    entries = spark.createDataFrame(pd.DataFrame({"item": items.item.astype(np.int32), "term": items.term.astype(np.int32), "weighted": weighted[2]}))
    index = store(stratified(rows, documents, length))
    limits = store(bounds(index, entries))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    before = F.coalesce(F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = store(limits.withColumn("first", before < max(k, FIRST_DOCS)))
    first = store(visit(index, ordered.filter("first").select("item", "m", F.lit(1).cast("long").alias("floor")), shipped, k))
    kth = _ranked(first, k).filter(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    rest = ordered.filter("not first").join(F.broadcast(kth), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    later = visit(index, rest.filter(F.col("bound") >= F.col("floor")).select("item", "m", "floor"), shipped, k)
    return _ranked(first.union(later), k)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text and at most as many items / 100."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("no", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(100))).first()[0] or 0
    parts = split_evenly(size, block_bytes)
    for p in range(parts):
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("id", "text", "no"), F.lit(parts)) == p)
        yield Items([(r["id"], r["text"]) for r in part.orderBy("no").collect()])  # about block_bytes of text


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows (``item_id``, ``rank`` from 1, ``doc_id``, ``score``): each item's ``k`` best documents
    of all ``docs`` with a score above 0, equal scores by ascending id, rows without an id last.

    Null and empty texts have no terms and are found by nothing; items without terms have no
    rows. Repeated rows of either table are rows of their own. Empty tables give an empty
    result; extra columns are ignored. Scores are exact, also for very long texts. Items are
    taken in blocks of about ``block_bytes`` of text (one longer item makes a larger block); each
    block reads the documents once.
    """
    spark: SparkSession = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {kinds[1]}, rank int, {id_col} {kinds[0]}, score long")
    parts = []
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        found = _search_block(docs, block, k, id_col, text_col)
        if found is not None:
            names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kinds[1]}")
            parts.append(found.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    for p in parts:
        out = p if len(parts) == 1 else out.union(p)
    return out
