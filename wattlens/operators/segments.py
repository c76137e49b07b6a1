"""Elementary segments: the intervals between a unit's distinct window bounds.

Every input of capacity, state and attribution is constant inside a segment, so one row
stands for many hours; hours are generated only at output. The bounds of a unit-month are a
set of at most 745 whole hours; each report meets the bounds of the months
it touches and gives one narrow row per segment that it covers. Reports are dealt by (unit, month),
and the rows made of them, many times as many, are not dealt again: a busy unit spreads over
as many tasks as it has months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import one_hour, period_unit, ts, whole_hours
from .bridging import UNIT

CHUNK = "chunk"


def chunk_starts(start, end):
    """Month starts touched by [start, end)."""
    last = end - F.expr("INTERVAL 1 MICROSECOND")
    return F.sequence(F.date_trunc("month", start), F.date_trunc("month", last), F.expr("INTERVAL 1 MONTH"))


def cut(df: DataFrame, start: str, end: str, keep: list[str]) -> DataFrame:
    """One row per month of [start, end): ``chunk`` and the clipped ``ws``, ``we``."""
    chunk_end = F.add_months(CHUNK, 1).cast("timestamp")
    return (
        df.filter(F.col(end) > F.col(start))
        .select(*keep, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(chunk_starts(F.col(start), F.col(end))).alias(CHUNK))
        .withColumn("ws", F.greatest("_s", CHUNK)).withColumn("we", F.least("_e", chunk_end))
        .drop("_s", "_e")
    )


WINDOWS = (("start_out", "end_out"), ("start_derate", "end_derate"))


def _pieces(work: DataFrame, start: str, end: str, keep: list[str]) -> DataFrame:
    """Reports dealt by unit and by the months they touch: the stretch ``ws``, ``we`` of both windows
    and the bounds ``_b0`` to ``_b3`` of each inside the month. One row more a month, without
    report (``_none``), has the month's own bounds, where it is inside [start, end)."""
    windows = [c for w in WINDOWS for c in w]
    s, e = F.least(*[s for s, _ in WINDOWS]), F.greatest(*[e for _, e in WINDOWS])
    own = cut(work.withColumns({"_s0": s, "_e0": e}), "_s0", "_e0", [UNIT, *dict.fromkeys([*keep, *windows])]).drop("ws", "we")
    months = work.select(UNIT).distinct().select(UNIT, F.explode(chunk_starts(ts(start), ts(end))).alias(CHUNK))
    first, last = F.date_trunc("month", ts(start)), F.date_trunc("month", ts(end) - F.expr("INTERVAL 1 MICROSECOND"))
    beyond = (F.col(CHUNK) < first) | (F.col(CHUNK) > last)
    none = months.unionByName(own.filter(beyond).select(UNIT, CHUNK).distinct()).withColumn("_none", F.lit(True))
    d = own.withColumn("_none", F.lit(False)).unionByName(none, allowMissingColumns=True).repartition(UNIT, CHUNK)
    # what follows from times and month is not dealt
    month_end = F.add_months(CHUNK, 1).cast("timestamp")
    study = F.col("_none") & ~beyond
    places = {"ws": F.when(study, F.greatest(ts(start), CHUNK)).when(~F.col("_none"), F.greatest(s, CHUNK)),
              "we": F.when(study, F.least(ts(end), month_end)).when(~F.col("_none"), F.least(e, month_end))}
    for k, (a, b) in enumerate(WINDOWS):
        here = (F.col(b) > F.col(a)) & (F.col(a) < month_end) & (F.col(b) > F.col(CHUNK))
        places |= {f"_b{2 * k}": F.when(here, F.greatest(a, CHUNK)), f"_b{2 * k + 1}": F.when(here, F.least(F.col(b), month_end))}
    for k, c in ((0, "ws"), (1, "we")):
        places[f"_b{k}"] = F.when(F.col("_none"), places[c]).otherwise(places[f"_b{k}"])
    return d.select(UNIT, CHUNK, *keep, "_none", *[c.alias(n) for n, c in places.items()])


def bounds(work: DataFrame, start: str, end: str) -> DataFrame:
    """Per unit and month the sorted distinct bounds of its reports' windows and of the month.

    Bounds are whole hours, so a row holds at most 745 of them however many reports there are.
    """
    each = _pieces(work, start, end, []).select(UNIT, CHUNK, F.explode(F.array("_b0", "_b1", "_b2", "_b3")).alias("b"))
    return each.groupBy(UNIT, CHUNK).agg(F.array_sort(F.collect_set("b")).alias("bounds"))


def _between(frame: DataFrame, keep: list[str], first: Column, last: Column) -> DataFrame:
    """One row per segment between places ``first`` and ``last`` (from 1) of ``bounds``."""
    at = F.explode(F.when(last > first, F.sequence(first, last - 1))).alias("_i")
    rows = frame.select(*keep, "bounds", at)
    return rows.select(*keep, F.get("bounds", F.col("_i") - 1).alias("seg_start"), F.get("bounds", F.col("_i")).alias("seg_end"))


def covered(work: DataFrame, start: str, end: str, keep: list[str]) -> DataFrame:
    """Segments tiling [start, end) per unit with the reports that cover them.

    One row per segment and report, with columns ``keep`` of ``work`` and flags ``in_c`` (its
    outage window covers the segment) and ``in_a`` (its deration window does), and one row per
    segment with neither, which keeps segments without any report. Reports are dealt by (unit,
    month) once: they meet the bounds there, and the rows made of them stay in their task.
    """
    month = Window.partitionBy(UNIT, CHUNK)
    sets = [F.collect_set(f"_b{k}").over(month).alias(f"_s{k}") for k in range(4)]
    met = _pieces(work, start, end, keep).select(UNIT, CHUNK, *keep, "ws", "we", "_none", *sets)
    met = met.withColumn("bounds", F.array_sort(F.array_distinct(F.concat("_s0", "_s1", "_s2", "_s3")))).drop("_s0", "_s1", "_s2", "_s3")
    # an empty window leaves no bounds, so its end of the stretch is found by comparison
    at = lambda c: F.array_position("bounds", F.col(c)).cast("int")
    first = F.when(F.col("_none"), 1).when(at("ws") > 0, at("ws")).otherwise(F.size(F.filter("bounds", lambda b: b < F.col("ws"))) + 1)
    last = F.when(F.col("_none"), F.size("bounds")).when(at("we") > 0, at("we")).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col("we"))))
    rows = _between(met, [UNIT, CHUNK, *keep, "_none"], first, last)
    holds = lambda s, e: F.coalesce((F.col(s) <= F.col("seg_start")) & (F.col(e) >= F.col("seg_end")), F.lit(False))
    rows = rows.withColumn("in_c", holds(*WINDOWS[0])).withColumn("in_a", holds(*WINDOWS[1]))
    return rows.filter(F.col("in_c") | F.col("in_a") | F.col("_none")).drop("_none")


def split_at_period(df: DataFrame, period: str, start: str = "seg_start", end: str = "seg_end") -> DataFrame:
    """Cut intervals at the period's inner boundaries (weeks may cross months)."""
    unit = period_unit(period)
    if unit is None:
        return df
    step = {"month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR", "week": "INTERVAL 7 DAY"}[unit]
    last = F.date_trunc(unit, F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    first = F.date_trunc(unit, F.col(start))
    # most intervals stay inside one period; only the others are multiplied
    cuts = F.when(first == last, F.array(first)).otherwise(F.sequence(first, last, F.expr(step)))
    rest = [c for c in df.columns if c not in (start, end)]
    return (
        df.select("*", F.explode(cuts).alias("_p"))
        .select(*[F.col(f"`{c}`") for c in rest], F.greatest(start, "_p").alias(start),
                F.least(F.col(end), (F.col("_p") + F.expr(step)).cast("timestamp")).alias(end))
    )


def to_hours(df: DataFrame, start: str = "seg_start", end: str = "seg_end", out: str = "timestamp") -> DataFrame:
    """One row per hour of each interval."""
    hours = F.sequence(F.col(start), F.col(end) - one_hour(), one_hour())
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (start, end)]
    return df.filter(F.col(end) > F.col(start)).select(F.explode(hours).alias(out), *rest)


def from_hours(df: DataFrame, at: str = "timestamp") -> DataFrame:
    """Hourly rows as one-hour intervals; every interval operator accepts them."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != at]
    return df.select(F.col(at).alias("seg_start"), (F.col(at) + one_hour()).alias("seg_end"), *rest)


def n_hours(start: str = "seg_start", end: str = "seg_end"):
    return whole_hours(start, end)
