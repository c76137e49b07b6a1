"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are lifted onto a sphere (one more component), where the largest inner product is
the least distance. Each table cuts a few Gaussian (2-stable) projections into cells of one
width; a cell is a bucket. A query visits its own bucket and those of perturbed cells, in
the order of their estimated success (the squared distances of its projections to the cell
borders that are crossed), merges what the tables give and ranks it by the exact measure.
Every vector is in every table; equal vectors are one entry with their smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, split_evenly, store

TABLES, FUNCTIONS, WIDTH, PROBES = 4, 6, 2.0, 81
BLOCK = 4096  # about as many vectors of a bucket stand together
PART = 16_000  # about as many vectors are held by a task


class Hashes:
    """Projections of all tables, from a seed; ``limit``: the largest norm of the corpus."""

    def __init__(self, size: int, limit: float, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.limit, self.tables, self.functions = limit or 1.0, tables, functions
        self.a = rng.normal(size=(size + 1, tables * functions)) / width
        self.b = rng.random(tables * functions)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.limit
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def cells(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and places inside the cells: rows x tables x functions."""
        f = (self.lift(x, query) @ self.a + self.b).reshape(len(x), self.tables, self.functions)
        cell = np.floor(f)
        return cell.astype(np.int64), f - cell

    def bucket(self, table: np.ndarray | int, cell: np.ndarray) -> np.ndarray:
        """One number for table and cells; cells are near 0, since lifted vectors have length 1."""
        out = np.asarray(table, np.int64)
        for j in range(self.functions):
            out = out * 64 + (cell[..., j] + 32)
        return out


def perturbations(inside: np.ndarray, probes: int) -> list[tuple[tuple[int, int], ...]]:
    """The ``probes`` sets of moves (function, -1 or +1) with the least sum of squared
    distances, by a heap of sets that shift or extend their last member."""
    n = len(inside)
    moves = sorted([(float(inside[j]) ** 2, j, -1) for j in range(n)] + [(float(1 - inside[j]) ** 2, j, 1) for j in range(n)])
    out: list[tuple] = [()]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        used = [moves[i][1] for i in chosen]
        if len(set(used)) == len(used):
            out.append(tuple((moves[i][1], moves[i][2]) for i in chosen))
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (score - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + moves[last + 1][0], (*chosen, last + 1)))
    return out


def probed(hashes: Hashes, cell: np.ndarray, inside: np.ndarray, probes: int) -> list[int]:
    """Buckets that one query visits, over all tables."""
    out = []
    for t in range(hashes.tables):
        sets = perturbations(inside[t], probes)
        moved = np.repeat(cell[t][None], len(sets), axis=0)
        for i, moves in enumerate(sets):
            for j, d in moves:
                moved[i, j] += d
        out += hashes.bucket(t, moved).tolist()
    return out


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero, whatever its sign


def search(rows: DataFrame, k: int = 20, every: int = 20, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest inner product for every row whose id divides by ``every``.

    Returns query_id, rank (from 1), the neighbour's id and score (inner product of the
    original vectors, in double precision), nearest first, ties to the smaller id. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without an id or vectors of another length than most (of the smaller length, where
    two are as frequent). Repeated rows count once; a row never finds its own id. A query
    that finds fewer than ``k`` visits all buckets of the first table, which hold every row.
    Empty table: no rows. Other columns are neither read nor returned.
    """
    spark = rows.sparkSession
    valid = _valid(rows, id_col, vector_col)
    names = ["query_id", "rank", id_col, "score"]
    none = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    common = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return none
    size = common["n"]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    valid = store(valid.filter(F.size("v") == size).select("id", "v", F.xxhash64("v").alias("h"), norm.alias("norm")).dropDuplicates(["id", "h"]))
    limit = valid.agg(F.max("norm")).first()[0]
    if limit is None:
        return none
    hashes = Hashes(size, limit)

    # equal vectors: one entry with the k + 1 smallest ids, which is all that a result can use
    smallest = Window.partitionBy("h").orderBy("id")
    few = valid.withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= k + 1)
    entries = store(few.groupBy("h").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            cell, _ = hashes.cells(np.vstack(b["v"]), False)
            for t in range(hashes.tables):
                yield pd.DataFrame({"h": b["h"], "bucket": hashes.bucket(t, cell[:, t])})

    at = store(map_batches(entries.select("h", "v"), placed, "h long, bucket long"))
    held = at.groupBy("bucket").count().collect()  # bounded: cells of unit vectors, whatever the corpus
    blocks = {r["bucket"]: split_evenly(r["count"], BLOCK) for r in held}
    parts = split_evenly(sum(r["count"] for r in held), PART)
    told = spark.sparkContext.broadcast(blocks)
    of_first = [b for b in blocks if b < 64 ** hashes.functions]

    def part_of(bucket: int, block: int) -> int:
        return (bucket * 1_000_003 + block * 7_919) % 2_147_483_647 % parts

    def data(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            block = [h % told.value[u] for h, u in zip(b["h"].tolist(), b["bucket"].tolist())]
            part = [part_of(u, s) for u, s in zip(b["bucket"].tolist(), block)]
            yield pd.DataFrame({"part": part, "kind": 0, "h": b["h"], "v": b["v"], "ids": b["ids"], "at": [[u, s] for u, s in zip(b["bucket"].tolist(), block)]})

    def ask(everything: bool):
        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                cell, inside = hashes.cells(np.vstack(b["v"]), True)
                out = []
                for i, (h, v) in enumerate(zip(b["h"].tolist(), b["v"])):
                    visits: dict[int, list[int]] = {}
                    for u in of_first if everything else probed(hashes, cell[i], inside[i], probes):
                        for s in range(told.value.get(u, 0)):
                            visits.setdefault(part_of(u, s), []).extend((u, s))
                    out += [(p, 1, h, v, None, x) for p, x in visits.items()]
                yield pd.DataFrame(out, columns=["part", "kind", "h", "v", "ids", "at"])
        return probe

    columns = "part int, kind int, h long, v array<double>, ids array<long>, at array<long>"
    stored = map_batches(at.join(entries, "h"), data, columns)
    wanted = store(valid.filter(F.col("id") % every == 0).select("id", "h", "v"))
    asked = wanted.groupBy("h").agg(F.first("v").alias("v"))

    def found(asked: DataFrame, everything: bool) -> DataFrame:
        both = stored.union(map_batches(asked.select("h", "v"), ask(everything), columns))
        dealt = both.repartition(parts, "part").sortWithinPartitions("part", "kind")
        near = map_batches(dealt, lambda batches: _rank(batches, k + 1, hashes.tables), "qh long, id long, score double")
        best = Window.partitionBy("qh").orderBy(F.desc("score"), "id")
        return near.distinct().withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")

    def result(near: DataFrame) -> DataFrame:
        pairs = wanted.select(F.col("id").alias("query_id"), "h").join(near, F.col("h") == F.col("qh")).filter(F.col("query_id") != F.col("id"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")

    near = store(found(asked, False))
    counted = near.groupBy("qh").count().filter(F.col("count") > k).select(F.col("qh").alias("h"))
    short = store(asked.join(counted, "h", "left_anti"))
    if short.head(1):
        near = near.join(short, F.col("qh") == F.col("h"), "left_anti").union(found(short, True))
    return result(near).select(*names)


def _rank(batches: Iterator[pd.DataFrame], k: int, tables: int) -> Iterator[pd.DataFrame]:
    """Per part: its entries by bucket and block, then its queries in chunks. An entry stands in
    a part once for each table at most, so ``tables`` * ``k`` places hold ``k`` different ones."""
    part, rows, blocks, waiting = None, [], None, []
    best: dict[int, list[tuple[float, int]]] = {}  # over the parts of this task; flushed when large

    def close() -> None:
        nonlocal blocks
        if blocks is None:
            by: dict[tuple[int, int], list[int]] = {}
            for i, r in enumerate(rows):
                by.setdefault((int(r[2][0]), int(r[2][1])), []).append(i)
            blocks = {x: (np.vstack([rows[i][0] for i in at]), np.array(at)) for x, at in by.items()}

    def answer() -> None:
        if not waiting:
            return
        close()
        q = np.vstack([w[1] for w in waiting])
        visits: dict[tuple[int, int], list[int]] = {}
        for i, w in enumerate(waiting):
            for x in zip(w[2][::2].tolist(), w[2][1::2].tolist()):
                visits.setdefault(x, []).append(i)
        room = k * tables
        top, which = np.full((len(q), room), -np.inf), np.full((len(q), room), -1)
        for x, asking in visits.items():
            if x not in blocks:
                continue
            v, at = blocks[x]
            score = q[asking] @ v.T
            all_s = np.hstack([top[asking], score])
            all_w = np.hstack([which[asking], np.broadcast_to(at, score.shape)])
            keep = np.argpartition(-all_s, room - 1, axis=1)[:, :room]
            top[asking], which[asking] = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_w, keep, 1)
        for i, w in enumerate(waiting):
            at = np.unique(which[i][which[i] >= 0])
            if not len(at):
                continue
            exact = (np.vstack([rows[j][0] for j in at]) * w[1]).sum(axis=1)  # the same sum for equal vectors
            mine = best.setdefault(w[0], [])
            for j, s in zip(at.tolist(), exact.tolist()):
                mine.extend((-s, int(x)) for x in rows[j][1])
            best[w[0]] = sorted(set(mine))[:k]
        waiting.clear()

    def flush() -> Iterator[pd.DataFrame]:
        out = [(h, x, -s) for h, m in best.items() for s, x in m]
        best.clear()
        yield pd.DataFrame(out, columns=["qh", "id", "score"])

    for b in batches:
        for p, kind, h, v, ids, at in zip(b["part"], b["kind"], b["h"], b["v"], b["ids"], b["at"]):
            if p != part:
                answer()
                part, rows, blocks = p, [], None
            if kind == 0:
                rows.append((v, ids, at))
            else:
                waiting.append((h, v, at))
                if len(waiting) >= 512:
                    answer()
        if len(best) > 50_000:
            yield from flush()
    answer()
    yield from flush()
