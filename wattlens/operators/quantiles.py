"""Exact interpolated quantiles by distributed selection.

An exact percentile as an aggregate holds every distinct value of a group in one task. Here the
values are counted first (combined before the shuffle, dealt by value), approximate cuts from a
bounded sketch deal each group's values over buckets, bucket totals tell which buckets hold the
two neighbours of each wanted rank, and only those are sorted: about a thousandth of a group's
distinct values a task. The cuts only steer the work; the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rows import same_keys

FAN = 32  # cuts are looked up in two steps of FAN each


def quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float], weight: Column | None = None) -> DataFrame:
    """Rows (keys, one column per name of ``wanted``): the quantiles of the non-NULL values of a
    group, linearly interpolated between ranks; NULL keys form groups. ``weight`` counts a value
    several times (whole numbers; rows with none are left out). Groups without values have no row."""
    k = F.struct(*[F.col(f"`{c}`") for c in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.select(k.alias("_k"), value.cast("double").alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    counts = rows.filter(F.col("_v").isNotNull() & (F.col("_w") > 0)).groupBy("_k", "_v").agg(F.sum("_w").alias("_c"))
    at = [i / (FAN * FAN) for i in range(1, FAN * FAN)]
    cuts = counts.groupBy("_k").agg(F.percentile_approx("_v", at, 4 * FAN * FAN).alias("_cuts"), F.sum("_c").alias("_n"))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(FAN - 1)), lambda i: F.element_at("_cuts", i * FAN))
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col("_v")))
    step = counts.join(cuts.select("_k", "_cuts"), "_k").withColumn("_i", below(coarse))
    dealt = step.withColumn("_b", F.col("_i") * FAN + below(F.slice("_cuts", F.col("_i") * FAN + 1, F.lit(FAN)))).select("_k", "_v", "_c", "_b")
    order = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # at most FAN x FAN buckets a group
    totals = dealt.groupBy("_k", "_b").agg(F.sum("_c").alias("_t")).withColumn("_to", F.sum("_t").over(order))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in wanted.items()])).alias("_q")
    place = cuts.select("_k", "_n", asked).select("_k", "_q.name", (F.col("_q.p") * (F.col("_n") - 1)).alias("_pos"))
    ranks = place.select("*", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_r"))
    found = ranks.join(totals, "_k").filter((F.col("_r") < F.col("_to")) & (F.col("_r") >= F.col("_to") - F.col("_t"))).select(
        "_k", "_b", "name", "_pos", "_r", (F.col("_r") - F.col("_to") + F.col("_t")).alias("_in"))
    held = dealt.join(found.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi")
    run = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_upto", F.sum("_c").over(run))
    met = found.join(held, ["_k", "_b"]).filter((F.col("_in") < F.col("_upto")) & (F.col("_in") >= F.col("_upto") - F.col("_c")))
    share = F.when(F.floor("_pos") == F.ceil("_pos"), 1.0).when(F.col("_r") == F.floor("_pos"), F.ceil("_pos") - F.col("_pos")).otherwise(F.col("_pos") - F.floor("_pos"))
    out = met.groupBy("_k").agg(*[F.sum(F.when(F.col("name") == n, share * F.col("_v"))).alias(n) for n in wanted])
    return out.select(*[F.col(f"_k.`{c}`").alias(c) for c in keys], *wanted)


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float], weight: Column | None = None) -> DataFrame:
    """``grouped`` (one row per key of ``df``) with the quantiles as columns."""
    q = quantiles(df, keys, value, wanted, weight)
    if not keys:
        one = grouped.withColumn("_q", q.select(F.struct(*wanted)).scalar())
        return one.select("*", *[F.col(f"_q.`{n}`") for n in wanted]).drop("_q")
    return grouped.alias("g").join(q.alias("q"), same_keys("g", "q", keys), "left").select("g.*", *[F.col(f"q.`{n}`") for n in wanted])
