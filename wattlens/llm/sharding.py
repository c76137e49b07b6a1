"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts together.

Items are groups of equal texts. A group that weighs much is an item of its own; the many
light groups are gathered by a hash of their text into a fixed number of cells, so that the
number of items is bounded by the parameters and not by the corpus. Items are placed in
descending order of weight where the dot product of their vector with the shard's residual
capacity is highest. A group that outweighs a whole shard is cut into portions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import gapless, store

MEASURES = ("bytes", "tokens", "rows")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: items; columns: measures) by the dot-product rule.

    Capacity of a shard is its fair share of each measure. Vectors and residuals are in units
    of that share. A shard whose residual is too small in some measure is taken only if no
    shard has room; then the one with the largest smallest residual is taken.
    """
    share = np.maximum(items.sum(axis=0) / shards, 1e-12)
    vectors = items / share
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -vectors.max(axis=1))):
        v = vectors[i]
        room = (left >= v - 1e-9).all(axis=1)
        score = np.where(room, left @ v, -np.inf) if room.any() else (left - v).min(axis=1)
        j = int(np.argmax(score))
        out[i] = j
        left[j] -= v
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16,
          tokens: Column | None = None, cells: int = 8192, heavy: int = 64) -> DataFrame:
    """Assign every row to a shard: the id, size, tokens, text_crc32, shard and slot.

    ``size``: UTF-8 bytes plus ``row_bytes``; ``tokens``: words divided by single spaces or line
    ends unless given. A group above 1/``heavy`` of a shard's share in any measure is an item
    of its own; there are at most 3 * ``shards`` * ``heavy`` such groups besides the ``cells``.
    A group above the whole share of a shard in any measure is cut into portions of at most
    half a share, by a hash of the id, because no shard could hold it.

    Null text: no bytes, no tokens, checksum 0, a group of its own with empty texts. Repeated
    rows are rows of their own with slots of their own. Empty table: no rows. Null id: as any
    other row. Other columns are neither read nor returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = tokens if tokens is not None else F.when(text == "", F.lit(0)).otherwise(
        F.length(text) - F.length(F.translate(text, " \n", "")) + 1)
    slim = store(docs.select(F.col(id_col), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), words.cast("long").alias("tokens"),
                             F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group")))
    whole = slim.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    share = [max(1, x or 0) / shards for x in whole]
    groups = slim.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    weight = F.greatest(*[F.col(m) / s for m, s in zip(MEASURES, share)])
    groups = groups.withColumn("weight", weight)
    alone = groups.filter(F.col("weight") > 1 / heavy).select("group", *MEASURES, "weight").toPandas()
    light = groups.filter(F.col("weight") <= 1 / heavy).groupBy(F.pmod("group", F.lit(cells)).cast("int").alias("cell")).agg(
        *[F.sum(m).alias(m) for m in MEASURES]).toPandas()

    portions = np.where(alone["weight"] > 1, np.ceil(2 * alone["weight"]), 1).astype(int)
    cut = alone.loc[alone.index.repeat(portions)]
    vectors = np.vstack([cut[list(MEASURES)].to_numpy(float) / np.repeat(portions, portions)[:, None], light[list(MEASURES)].to_numpy(float)])
    where = place(vectors, shards) if len(vectors) else np.zeros(0, int)

    spark = docs.sparkSession
    ends = np.cumsum(portions)
    own = [(int(g), where[e - p:e].tolist()) for g, p, e in zip(alone["group"], portions, ends)]
    rest = dict(zip(light["cell"].tolist(), where[len(cut):].tolist()))
    by_cell = F.lit(_packed([rest.get(c, 0) for c in range(cells)]))
    place_of_cell = F.conv(F.substring(by_cell, F.pmod("group", F.lit(cells)).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int")
    heavies = spark.createDataFrame(own, "group long, places array<int>")
    joined = slim.join(F.broadcast(heavies), "group", "left")  # at most 3 * shards * heavy rows
    nth = F.pmod(F.xxhash64(id_col, "text_crc32"), F.size("places").cast("long")).cast("int")
    placed = joined.withColumn("shard", F.when(F.col("places").isNull(), place_of_cell).otherwise(F.get("places", nth)))
    return gapless(placed.drop("places", "group"), ["shard"], [F.col(id_col), F.col("text_crc32"), F.col("size")], "slot")


def _packed(values: list[int]) -> str:
    return "".join(f"{v:04x}" for v in values)
