"""Closing short gaps between a unit's consecutive windows.

Only the last row of a start time can have a positive gap to the next start, so rows
are first reduced to one per (unit, start). Starts are whole hours: the window then
holds at most one row per hour of the horizon, however many reports a unit has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..functions.times import FAR_FUTURE, FAR_PAST, hours_between, ts
from ..session import materialise
from .rows import require

UNIT = "unit_id"


def with_unit_id(df: DataFrame) -> DataFrame:
    """One text key per series: area code, asset type and unit."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.withColumn(UNIT, F.concat_ws("|", blank("area_code"), blank("asset_type"), blank("unit_eic")))


def _order(start: str) -> list[Column]:
    """Reading order of a unit's reports; the id and bounds make it total."""
    return [
        F.coalesce("document_sort_time", ts(FAR_FUTURE)).alias("doc"), F.col("mrid").alias("m"),
        F.col("start_out").alias("so"), F.col("end_out").alias("eo"),
        F.col("start_derate").alias("sd"), F.col("end_derate").alias("ed"),
    ]


def _bridgeable(df: DataFrame, end: str, nxt: Column, first: str, max_hours: float,
                same_type: bool, same_reason: bool) -> Column:
    gap = hours_between(F.col(end), nxt)
    ok = (gap > 0) & (gap <= max_hours)
    if same_type:
        ok = ok & F.lower(F.trim("outage_type")).eqNullSafe(F.lower(F.trim(F.col(f"{first}.outage_type"))))
    if same_reason:
        ok = ok & (text.reason_class("reason") == text.reason_class(F.col(f"{first}.reason")))
    return F.coalesce(ok, F.lit(False))


def _next_starts(df: DataFrame, start: str) -> DataFrame:
    """One row a start with the unit's next one. Starts are whole hours: an array of a unit's
    holds no more than its horizon."""
    starts = df.groupBy(UNIT).agg(F.array_sort(F.collect_set(start)).alias("_s"))
    each = F.explode(F.arrays_zip(F.slice("_s", 1, F.size("_s") - 1).alias(start), F.slice("_s", 2, F.size("_s") - 1).alias("_next")))
    return starts.filter(F.size("_s") > 1).select(UNIT, each.alias("_e")).select(UNIT, "_e.*")


def bridge_outage_windows(df: DataFrame, max_hours: float = 8, same_type: bool = False,
                          same_reason: bool = False) -> DataFrame:
    """Stretch an outage window to the unit's next start when the gap is in (0, max_hours]."""
    if max_hours <= 0:
        return df
    if same_type or same_reason:
        return _bridge_alike(df, max_hours, same_type, same_reason)
    starts = _next_starts(df, "start_out")
    last = F.rank().over(Window.partitionBy(UNIT, "start_out").orderBy(F.struct(*_order("start_out")).desc()))
    met = df.join(starts, [UNIT, "start_out"], "left").withColumn("_nth", last)
    ok = (F.col("_nth") == 1) & _bridgeable(met, "end_out", F.col("_next"), "", max_hours, False, False)
    return met.withColumn("end_out", F.when(ok, F.col("_next")).otherwise(F.col("end_out"))).select(*df.columns)


def _bridge_alike(df: DataFrame, max_hours: float, same_type: bool, same_reason: bool) -> DataFrame:
    """The bridge where the next start's first report must be of the same kind."""
    order = F.struct(*_order("start_out"))
    first = F.struct(*_order("start_out"), F.col("outage_type"), F.col("reason"))
    starts = df.groupBy(UNIT, "start_out").agg(F.max(order).alias("_last"), F.min(first).alias("_head"))
    w = Window.partitionBy(UNIT).orderBy("start_out")
    starts = starts.select(UNIT, "start_out", "_last", F.lead("start_out").over(w).alias("_next"),
                           F.lead("_head").over(w).alias("_next_head")).filter(F.col("_next").isNotNull())
    ok = (order == F.col("_last")) & _bridgeable(df, "end_out", F.col("_next"), "_next_head", max_hours, same_type, same_reason)
    return (
        df.join(starts, [UNIT, "start_out"], "left")
        .withColumn("end_out", F.when(ok, F.col("_next")).otherwise(F.col("end_out")))
        .select(*df.columns)
    )


def deration_bridges(df: DataFrame, max_hours: float, same_type: bool = False, same_reason: bool = False,
                     tie: str = "lowest") -> DataFrame:
    """New rows covering gaps in (0, max_hours] between deration windows, copied from the
    neighbour with the newer document (ties by the capacity rule, then the earlier one)."""
    require(tie, ("lowest", "highest"), "tie")
    # the last row of each start that ends short of the next start, with that one's first row
    keyed = df.withColumn("_k", F.coalesce("start_derate", ts(FAR_PAST)))
    order = [*_order("start_derate"), *[F.col(c) for c in df.columns]]
    nth = lambda by: F.row_number().over(Window.partitionBy(UNIT, "_k").orderBy(*by))
    row = F.struct(*df.columns)
    lefts = keyed.withColumn("_nth", nth([c.desc_nulls_last() for c in order])).filter("_nth = 1").join(_next_starts(keyed, "_k"), [UNIT, "_k"])
    lefts = lefts.filter(_bridgeable(lefts, "end_derate", F.col("_next"), "", max_hours, False, False)).select(
        F.col(UNIT).alias("_u"), F.col("_next").alias("_k"), row.alias("left"))
    heads = keyed.withColumn("_nth", nth([c.asc_nulls_first() for c in order])).filter("_nth = 1").select(F.col(UNIT).alias("_u"), "_k", row.alias("right"))
    pairs = lefts.join(heads, ["_u", "_k"]).select("left", "right", "left.end_derate", "left.outage_type", "left.reason")
    pairs = pairs.filter(_bridgeable(pairs, "end_derate", F.col("right.start_derate"), "right", max_hours, same_type, same_reason))
    old = ts("0001-01-02 00:00:00")
    ld, rd = (F.coalesce(f"{s}.document_sort_time", old) for s in ("left", "right"))
    la, ra = F.col("left.avail_capacity"), F.col("right.avail_capacity")
    better = (la <= ra) if tie == "lowest" else (la >= ra)
    use_left = (
        F.when(ld != rd, ld > rd)
        .when(la.isNotNull() & ra.isNotNull(), better)
        .otherwise(la.isNotNull() | ra.isNull())
    )
    src = pairs.select(F.when(use_left, F.col("left")).otherwise(F.col("right")).alias("s"),
                       F.col("left.end_derate").alias("g0"), F.col("right.start_derate").alias("g1"))
    over = {"start_out": "g0", "end_out": "g1", "start_derate": "g0", "end_derate": "g1"}
    return src.select(*[F.col(over[c]).alias(c) if c in over else F.col(f"s.`{c}`").alias(c) for c in df.columns])


def bridge_reports(df: DataFrame, max_outage_gap: float = 8, max_deration_gap: float = 0,
                   same_type: bool = False, same_reason: bool = False, tie: str = "lowest") -> DataFrame:
    """Both bridges; adds ``unit_id`` and ``is_deration_gap_bridge``."""
    df = bridge_outage_windows(with_unit_id(df), max_outage_gap, same_type, same_reason)
    if max_deration_gap > 0:
        df = materialise(df)  # read by the rows and by both sides of a gap
    out = df.withColumn("is_deration_gap_bridge", F.lit(False))
    if max_deration_gap > 0:
        extra = deration_bridges(df, max_deration_gap, same_type, same_reason, tie)
        out = out.unionByName(extra.withColumn("is_deration_gap_bridge", F.lit(True)))
    return out
