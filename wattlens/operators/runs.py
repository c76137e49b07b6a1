"""Gaps and islands over interval rows (an hourly row is an interval of one hour).

Windows are partitioned by unit. A unit's rows are disjoint in time, so a partition never
holds more than one row per hour of the study horizon; callers aggregate reports or
generation readings to that grain first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import whole_hours

START, END = "seg_start", "seg_end"


def hours_col() -> Column:
    return whole_hours(START, END)


def mark_runs(df: DataFrame, keys: list[str], label: Column, out: str = "run_id") -> DataFrame:
    """Number maximal runs of touching rows with equal ``label`` (NULL equals NULL)."""
    w = Window.partitionBy(*keys).orderBy(START)
    df = df.withColumn("_label", label)
    new = F.lag(END).over(w).isNull() | (F.lag(END).over(w) != F.col(START)) | ~F.lag("_label").over(w).eqNullSafe(F.col("_label"))
    df = df.withColumn("_new", new.cast("int"))
    return df.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_label", "_new")


def run_starts(df: DataFrame, keys: list[str], flags: dict[str, Column], period: Column | None = None) -> DataFrame:
    """Add ``<name>_on`` and ``<name>_start`` per flag in one window pass.

    A run starts where the flag turns true, after a gap, or where ``period`` changes.
    """
    w = Window.partitionBy(*keys).orderBy(START)
    df = df.withColumns({f"{n}_on": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    joined = F.coalesce(F.lag(END).over(w) == F.col(START), F.lit(False))
    if period is not None:
        df = df.withColumn("_p", period)
        joined = joined & F.coalesce(F.lag("_p").over(w) == F.col("_p"), F.lit(False))
    df = df.withColumn("_joined", joined)
    df = df.withColumns({
        f"{n}_start": F.col(f"{n}_on") & ~(F.col("_joined") & F.coalesce(F.lag(f"{n}_on").over(w), F.lit(False)))
        for n in flags})
    return df.drop("_joined", "_p")


def event_table(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Start, exclusive end and hours of each run of true rows."""
    df = mark_runs(df.withColumn("_f", F.coalesce(flag, F.lit(False))), keys, F.col("_f"))
    return df.filter("_f").groupBy(*keys, "run_id").agg(
        F.min(START).alias("start"), F.max(END).alias("end_excl"), F.sum(hours_col()).alias("dur_h")).drop("run_id")


def event_metrics(df: DataFrame, keys: list[str], flag: Column, value: Column | None = None) -> DataFrame:
    """Per key: number of runs K, their hours, and the value moments H, S, Q over true hours."""
    v = F.coalesce(value, F.lit(0.0)) if value is not None else F.lit(0.0)
    h = hours_col()
    d = run_starts(df.withColumn("_v", v), keys, {"x": flag})
    on = lambda c: F.coalesce(F.sum(F.when(F.col("x_on"), c)), F.lit(0))
    return d.groupBy(*keys).agg(
        F.sum(F.col("x_start").cast("long")).alias("K"), on(h).cast("long").alias("TOT_h"), on(h).cast("long").alias("H"),
        on(F.col("_v") * h).cast("double").alias("S"), on(F.col("_v") * F.col("_v") * h).cast("double").alias("Q"))


def merge_runs(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Compress touching rows with equal ``cols`` into one interval."""
    label = F.struct(*[F.col(c) for c in cols])
    d = mark_runs(df.select(*keys, START, END, *cols), keys, label)
    return d.groupBy(*keys, "run_id", *cols).agg(F.min(START).alias(START), F.max(END).alias(END)).drop("run_id")
