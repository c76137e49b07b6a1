"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, store

FOREST = 250_000  # links that a task holds at a time


class Forest:
    """Union-find over the few links that a task holds at a time; the root is the smallest id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        r = x
        while (n := self.up.get(r, r)) != r:
            r = n
        while (n := self.up.get(x, x)) != r:
            self.up[x] = r
            x = n
        return r

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> pd.DataFrame:
        """(a, b): each id that is no root with its root."""
        a = sorted(self.up)
        return pd.DataFrame({"a": a, "b": [self.root(x) for x in a]}, dtype="int64")


def contract(links: DataFrame) -> DataFrame:
    """The links of each task as stars of their smallest ids: same components, shorter paths. A task
    gives an id one link, or one for every FOREST links it reads."""
    def star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, n = Forest(), 0
        for b in batches:
            for a, z in zip(b["a"].tolist(), b["b"].tolist()):
                forest.union(a, z)
            n += len(b)
            if n >= FOREST:
                yield forest.stars()
                forest, n = Forest(), 0
        yield forest.stars()

    return map_batches(links.select("a", "b"), star, "a long, b long")


def _round(links: DataFrame) -> DataFrame:
    """A large star and a small star over links from larger to smaller ids: (a, b, moved). The
    least neighbour of an id, if it is below it, is its least ``b``; so a large star lets a link go on
    from its ``b`` to what is least there, and a small star turns all links of an id but the least
    one into links of their ``b``. A link stays one link, and none has moved where all are stars."""
    least = links.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("least"))
    large = links.join(least, F.col("b") == F.col("from"), "left").select("a", F.coalesce("least", "b").alias("b"), F.col("least").isNotNull().alias("moved"))
    # an id has a link or so for each task of ``contract``, so none is a large group here
    small = large.withColumn("least", F.min("b").over(Window.partitionBy("a"))).groupBy("a", "b", "least").agg(F.max("moved").alias("moved"))
    kept = F.col("b") == F.col("least")
    return small.select(F.when(kept, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"), (F.col("moved") | ~kept).alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every id of the links (a, b) but the roots themselves; root: smallest id reachable.

    Ids are longs and not null. A round is three shuffles of at most as many rows as there are
    links; the number of rounds grows with the logarithm of the longest path. Tasks contract their
    links before each, which spares rounds and the driver the plans of them.
    """
    now = links.filter(F.col("a") != F.col("b"))
    while True:
        now = store(_round(store(contract(now))))
        if not now.filter("moved").head(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
