"""Sums, counts and cuts along time, from interval bounds instead of hourly rows.

Four mechanisms that the other operators share:

- ``interval_sums``: +x at every start and -x at every end, added per bound before the shuffle,
  then a running sum. Intervals are cut at month starts first, so each month's running sum starts
  from zero: whatever is active there opens again, no total has to be carried, and no task holds
  more than the 745 bounds of a group and month, however many intervals the group has.
- ``cut_by``: intervals split where a set of disjoint runs begins or ends (a month's runs are one
  array of at most 372), each piece with the run that covers it.
- ``lowest``: overlapping intervals of a key resolved to one row per stretch.
- ``runs_of_hours``: hours with equal values joined to runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import one_hour
from .rows import best_row
from .runs import END, START, mark_runs
from .segments import split_at_period

SCALE = 10 ** 9  # sums run on whole billionths, so what is added is taken away exactly


def _month(c: str = START) -> Column:
    return F.date_trunc("month", F.col(c))


def interval_sums(df: DataFrame, keys: list[str], measures: dict[str, Column], nullable: tuple[str, ...] = (), count: str = "n_rows") -> DataFrame:
    """Sums of ``measures`` over the rows that cover each stretch of time, per key.

    Rows (keys, ``seg_start``, ``seg_end``, measures, ``count``): the stretches between the
    distinct bounds of a key's intervals that at least one interval covers, cut at month
    starts. Whole-number measures stay whole; others are exact to a billionth. A measure is 0
    where all its values are NULL, and NULL if it is named in ``nullable``.
    """
    types = df.select(*[c.alias(n) for n, c in measures.items()]).schema if measures else None
    whole = {n for n in measures if types[n].dataType.typeName() in ("integer", "long", "short", "byte")}
    scaled = {n: c.cast("long") if n in whole else F.round(c.cast("double") * F.lit(float(SCALE))).cast("long") for n, c in measures.items()}
    parts = {n: F.coalesce(c, F.lit(0).cast("long")) for n, c in scaled.items()}
    parts |= {f"_n_{n}": measures[n].isNotNull().cast("long") for n in nullable}
    parts[count] = F.lit(1).cast("long")
    key_cols = [F.col(f"`{k}`") for k in keys]
    rows = split_at_period(df.select(*key_cols, START, END, *[c.alias(n) for n, c in parts.items()]).filter(F.col(END) > F.col(START)), "M")
    bounds = rows.select(*key_cols, _month().alias("_m"), *parts, F.explode(F.array(
        F.struct(F.col(START).alias("b"), F.lit(1).cast("long").alias("sign")), F.struct(F.col(END).alias("b"), F.lit(-1).cast("long").alias("sign")))).alias("_e"))
    added = bounds.groupBy(*key_cols, "_m", F.col("_e.b").alias(START)).agg(*[F.sum(F.col(n) * F.col("_e.sign")).alias(n) for n in parts])
    w = Window.partitionBy(*key_cols, "_m").orderBy(START)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = added.select(*key_cols, START, F.lead(START).over(w).alias(END), *[F.sum(n).over(run).alias(n) for n in parts])
    out = out.filter(F.col(END).isNotNull() & (F.col(count) > 0))

    def back(n: str) -> Column:
        v = F.col(n) if n in whole else F.col(n) / F.lit(float(SCALE))
        return F.when(F.col(f"_n_{n}") > 0, v) if n in nullable else v

    return out.select(*key_cols, START, END, *[back(n).alias(n) for n in measures], count)


def runs_of_hours(hours: DataFrame, keys: list[str], values: list[str], at: str = "timestamp") -> DataFrame:
    """Runs (keys, ``seg_start``, ``seg_end``, values) of touching hours with equal ``values``,
    cut at month starts. Hours must be distinct per key."""
    cols = [F.col(f"`{c}`") for c in (*keys, *values)]
    d = hours.select(*cols, F.col(at).alias(START), (F.col(at) + one_hour()).alias(END)).withColumn("_m", _month())
    label = F.struct(*[F.col(f"`{v}`") for v in values]) if values else F.lit(1)
    marked = mark_runs(d, [*keys, "_m"], label)
    return marked.groupBy(*cols[:len(keys)], "_m", "run_id", *cols[len(keys):]).agg(F.min(START).alias(START), F.max(END).alias(END)).drop("_m", "run_id")


def cut_by(df: DataFrame, runs: DataFrame, keys: dict[str, Column], values: list[str], hit: str = "_run") -> DataFrame:
    """``df``'s intervals cut at month starts and where ``runs`` begin or end.

    ``runs``: disjoint per key and inside a month (``runs_of_hours``), with key columns named as
    in ``keys``, whose values are the matching expressions over ``df``. Each piece has column
    ``hit``: a struct (s, e, values) of the run that covers it, or NULL.
    """
    names = list(keys)
    run = F.struct(F.col(START).alias("s"), F.col(END).alias("e"), *[F.col(f"`{v}`") for v in values])
    by_month = runs.select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in names], _month().alias("_m"), run.alias("r")).groupBy(
        *[f"_k_{k}" for k in names], "_m").agg(F.array_sort(F.collect_list("r")).alias("_runs"))
    d = split_at_period(df, "M").withColumns({f"_k_{k}": c for k, c in keys.items()}).withColumn("_m", _month())
    d = d.join(by_month, [*[f"_k_{k}" for k in names], "_m"], "left").drop("_m", *[f"_k_{k}" for k in names])
    # the runs that touch the interval, then its bounds with theirs
    d = d.withColumn("_runs", F.filter("_runs", lambda r: (r["s"] < F.col(END)) & (r["e"] > F.col(START))))
    inner = F.filter(F.flatten(F.transform("_runs", lambda r: F.array(r["s"], r["e"]))), lambda b: (b > F.col(START)) & (b < F.col(END)))
    marks = F.when(F.size("_runs") > 0, F.array_sort(F.array_distinct(F.concat(F.array(START, END), inner)))).otherwise(F.array(START, END))
    d = d.withColumn("_b", marks)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (START, END)]
    pieces = d.select(*rest, "_runs", F.explode(F.arrays_zip(F.slice("_b", 1, F.size("_b") - 1).alias("s"), F.slice("_b", 2, F.size("_b") - 1).alias("e"))).alias("_p"))
    over = F.get(F.filter("_runs", lambda r: (r["s"] <= F.col("_p.s")) & (r["e"] >= F.col("_p.e"))), F.lit(0))
    return pieces.select(F.col("_p.s").alias(START), F.col("_p.e").alias(END), *rest, over.alias(hit))


def rejoined(df: DataFrame, keys: list[str]) -> DataFrame:
    """Touching intervals of a key, cut at month starts, that agree in every other column, as one."""
    key_cols = [F.col(f"`{k}`") for k in keys]
    rest = [c for c in df.columns if c not in (START, END, *keys)]
    marked = mark_runs(df.withColumn("_m", _month()), [*keys, "_m"], F.struct(*[F.col(f"`{c}`") for c in rest]))
    whole = marked.groupBy(*key_cols, "_m", "run_id").agg(F.min(START).alias(START), F.max(END).alias(END), F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_rest"))
    out = {c: F.col(f"`{c}`") if c in (START, END, *keys) else F.col(f"_rest.`{c}`").alias(c) for c in df.columns}
    return whole.select(*out.values())


def overlapped_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that have two intervals at one time."""
    return interval_sums(df, keys, {}).filter("n_rows > 1").select(*[F.col(f"`{k}`") for k in keys]).distinct()


def lowest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Overlapping intervals of a key resolved: per stretch the row with the lowest ``value``
    (missing values last, ties by the remaining columns). Keys without overlap pass unchanged."""
    key_cols = [F.col(f"`{k}`") for k in keys]
    busy = overlapped_keys(df, keys)
    alone = df.join(busy, keys, "left_anti")
    rows = split_at_period(df.join(busy, keys, "left_semi"), "M").withColumn("_m", _month())
    points = rows.select(*key_cols, "_m", F.explode(F.array(START, END)).alias("b"))
    marks = points.groupBy(*key_cols, "_m").agg(F.array_sort(F.collect_set("b")).alias("_b"))
    met = rows.join(marks, [*keys, "_m"])
    first, last = (F.array_position("_b", F.col(c)).cast("int") for c in (START, END))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (START, END)]
    each = met.select(*rest, "_b", F.explode(F.sequence(first, last - 1)).alias("_i"))
    cut = each.select(F.get("_b", F.col("_i") - 1).alias(START), F.get("_b", F.col("_i")).alias(END), *rest)
    best = best_row(cut, [*keys, START], [F.col(value).isNotNull(), -F.col(value)])
    return alone.select(START, END, *rest).unionByName(best)
