"""Helpers that the corpus operators share: tables, shared storage, ordered ranges, slots."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import store

__all__ = ["gapless", "in_ranges", "map_batches", "range_cuts", "range_of", "split_evenly", "store", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SLICE_BYTES = 4 << 20
_shipped: set[str] = set()


def _slices(batches):
    """Batches of wide rows in pieces, so that few long texts stand in a worker's memory at once."""
    for b in batches:
        step = max(64, b.num_rows * SLICE_BYTES // max(1, b.nbytes)) if b.num_rows else 1
        for s in range(0, max(1, b.num_rows), step):
            yield b.slice(s, step)
        pa.default_memory_pool().release_unused()  # workers share their machine's memory with the JVM


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """The batch as a frame; whole numbers with nulls stay whole numbers."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        nullable = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()} if col.null_count else {}
        out[name] = col.to_pandas(types_mapper=nullable.get)
    return pd.DataFrame(out)


def map_batches(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """Map an iterator of pandas frames to one of such, as ``mapInPandas`` does, with two
    differences: executors get this package with the job, and whole numbers with nulls
    don't become floats on the way."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "wattlens"), "zip", os.path.dirname(root), os.path.basename(root))
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        for out in fn(map(_frame, _slices(batches))):
            yield pa.RecordBatch.from_pandas(out[arrow.names], schema=arrow, preserve_index=False)

    return df.mapInArrow(run, target)


def split_evenly(rows: int, per_part: int) -> int:
    return max(1, -(-int(rows) // per_part))


def gapless(df: DataFrame, keys: list[str], order: list[Column], name: str, per_part: int = 50_000) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within ``keys``, in an order fixed by the values of ``order``.

    A key may hold a third of all rows: rows are dealt over sub-groups by a hash of ``order``,
    counted per sub-group, and only sub-groups (about ``per_part`` rows) are sorted in a task.
    Rows equal in all of ``order`` get consecutive numbers.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = split_evenly(most, per_part)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(parts)))
    if parts == 1:
        first = None
    else:
        before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
        first = salted.groupBy(*keys, "__salt").count().select(
            *keys, "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy(*keys, "__salt").orderBy(*order)
    out = salted.withColumn("__own", (F.row_number().over(own) - 1).cast("long"))
    if first is None:
        return out.withColumn(name, F.col("__own")).drop("__salt", "__own")
    on = [out[k].eqNullSafe(first[k]) for k in keys] + [out["__salt"] == first["__salt"]]
    joined = out.join(first, on, "left")
    return joined.select(*[out[c] for c in out.columns if c not in ("__salt", "__own")],
                         (out["__own"] + first["__first"]).alias(name))


def range_cuts(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 values of ``id_col`` that cut its rows into ranges of like counts."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    cuts = df.select(F.percentile_approx(id_col, at, 20 * parts).alias("c")).first()[0]
    return sorted(set(cuts or []))


def range_of(id_col: Column, cuts: list[int]) -> Column:
    """Number of the range of ``range_cuts`` that holds an id; ids before the first cut and nulls: 0."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.when(id_col.isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda c: c <= id_col)))


def in_ranges(docs: DataFrame, id_col: str, text_col: str, range_bytes: int = 32 << 20, most: int = 20_000) -> DataFrame:
    """Rows (range, copy, id, text) in ascending (id, hash of text), dealt by ranges of ids.

    Every partition holds whole ranges, each sorted. Behind a range stands a copy (``copy`` 1)
    of the row that follows it in the next range; behind the last one, of the first row of
    all. Null text is empty. Ranges have like row counts and about ``range_bytes`` of text;
    there are at most ``most``, so the list of their first rows is bounded. One id that
    holds many rows makes one long range, which is sorted on disk and streamed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = range_cuts(rows, "id", min(most, split_evenly(total, range_bytes)))
    rows = rows.withColumn("range", range_of(F.col("id"), cuts).cast("int"))
    firsts = rows.groupBy("range").agg(F.min(F.struct("id", F.xxhash64("text").alias("h"))).alias("first")).orderBy("range").collect()  # at most ``most`` rows
    if not firsts:
        return rows.select("range", F.lit(0).alias("copy"), "id", "text")
    before = [(firsts[i - 1]["range"], r["first"]["id"], r["first"]["h"]) for i, r in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = spark.createDataFrame(before, f"before int, first_id {kind}, h long")
    copies = rows.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("h"))).select(
        F.col("before").alias("range"), F.lit(1).alias("copy"), "id", "text").dropDuplicates(["range"])
    both = rows.select("range", F.lit(0).alias("copy"), "id", "text").union(copies)
    # more partitions than ranges, so that few share one
    return both.repartition(4 * len(firsts), "range").sortWithinPartitions("range", "copy", "id", F.xxhash64("text"))
