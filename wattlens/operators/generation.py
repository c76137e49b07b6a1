"""Metered generation per unit-hour and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays
from ..functions.maths import num
from ..functions.times import floor_hour, ts
from .runs import hours_col


def unit_hour_means(raw: DataFrame, start: str | None = None, end: str | None = None,
                    units: DataFrame | None = None, areas: list[str] | None = None) -> DataFrame:
    """Raw readings (several per hour, unit and area) to one mean row per unit-hour.

    ``units`` (column eic_code) restricts by semi join. Filters sit before the
    aggregation, so they reach the scan; the mean combines map-side.
    """
    d = raw.select(
        F.col("timestamp").cast("timestamp").alias("timestamp"), F.trim("eic_code").alias("eic_code"),
        F.trim("area_code").alias("area_code") if "area_code" in raw.columns else F.lit(None).cast("string").alias("area_code"),
        num("actual_generation_mw").alias("actual_generation_mw"),
        num("actual_consumption_mw").alias("actual_consumption_mw") if "actual_consumption_mw" in raw.columns
        else F.lit(None).cast("double").alias("actual_consumption_mw"))
    d = d.filter(F.col("eic_code").isNotNull() & F.col("timestamp").isNotNull())
    if start:
        d = d.filter(F.col("timestamp") >= ts(start))
    if end:
        d = d.filter(F.col("timestamp") < ts(end))
    if areas:
        d = d.filter(F.col("area_code").isin(*areas))
    if units is not None:
        d = d.join(units.select(F.trim("eic_code").alias("eic_code")).distinct(), "eic_code", "left_semi")
    return d.groupBy(floor_hour("timestamp").alias("timestamp"), "eic_code").agg(
        arrays.text_set("area_code", ";").alias("area_code"),
        F.avg("actual_generation_mw").alias("actual_generation_mw"),
        F.avg("actual_consumption_mw").alias("actual_consumption_mw"),
        F.count(F.lit(1)).alias("actual_generation_obs_count"))


def only_required(generation: DataFrame, required: DataFrame) -> DataFrame:
    """Generation of the asked (timestamp, eic_code) pairs."""
    return generation.join(required.select("timestamp", "eic_code").distinct(), ["timestamp", "eic_code"], "left_semi")


def to_plants(generation: DataFrame, plant_map: DataFrame) -> DataFrame:
    """Sum unit generation per plant-hour; ``plant_map`` has eic_code, plant_id."""
    return generation.join(plant_map.select("eic_code", "plant_id").distinct(), "eic_code").groupBy(
        "timestamp", F.col("plant_id").alias("eic_code")).agg(
        F.sum("actual_generation_mw").alias("actual_generation_mw"),
        F.sum("actual_consumption_mw").alias("actual_consumption_mw"),
        F.sum("actual_generation_obs_count").alias("actual_generation_obs_count"))


def unit_capacity(panel: DataFrame) -> DataFrame:
    """Largest installed capacity seen per unit."""
    return panel.groupBy("eic_code").agg(F.max("installed_capacity").alias("capacity_mw"))


def positive_hours(generation: DataFrame, capacity: DataFrame | None = None, min_share: float = 0.0) -> DataFrame:
    """Unit-hours above zero, or from ``min_share`` of the unit's capacity on."""
    d = generation.filter(F.col("timestamp").isNotNull() & F.col("actual_generation_mw").isNotNull()).withColumn(
        "timestamp", floor_hour("timestamp"))
    if min_share <= 0 or capacity is None:
        return d.filter(F.col("actual_generation_mw") > 0)
    return d.join(capacity.select("eic_code", "capacity_mw"), "eic_code").filter(
        F.col("actual_generation_mw") >= F.col("capacity_mw") * min_share)


def generation_bounds(positive: DataFrame) -> DataFrame:
    """First, last and number of positive hours per unit."""
    h = positive.groupBy("eic_code", "timestamp").agg(F.lit(1).alias("n"))
    return h.groupBy("eic_code").agg(
        F.min("timestamp").alias("first_generation_timestamp"), F.max("timestamp").alias("last_generation_timestamp"),
        F.sum("n").alias("generation_hours"))


def hours_in_windows(positive: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct positive (unit, hour) pairs inside each unit's window."""
    w = windows.filter(F.trim("eic_code") != "").groupBy(F.trim("eic_code").alias("eic_code")).agg(
        F.min("keep_start").alias("keep_start"), F.max("keep_end").alias("keep_end"))
    w = w.filter(F.col("keep_start").isNotNull() & F.col("keep_end").isNotNull())
    p = positive.select("eic_code", "timestamp").distinct()
    return p.join(w, "eic_code").filter(
        (F.col("timestamp") >= F.col("keep_start")) & (F.col("timestamp") <= F.col("keep_end"))).select("eic_code", "timestamp")


def counts_in_windows(positive: DataFrame, windows: DataFrame) -> DataFrame:
    return hours_in_windows(positive, windows).groupBy("eic_code").agg(F.count(F.lit(1)).alias("generation_hours_in_period"))


def unit_codes(panel: DataFrame) -> DataFrame:
    return panel.select(F.trim("eic_code").alias("eic_code")).filter("eic_code <> ''").distinct()


# --- comparison of a reading with the panel -------------------------------------------


def tolerance(installed: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """max(absolute MW, share of installed capacity)."""
    base = F.greatest(F.coalesce(installed, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(max(float(absolute), 0.0)), base * float(relative))


def capped(generation: Column, installed: Column) -> Column:
    """Generation not above installed capacity (uncapped without one)."""
    g = F.greatest(F.coalesce(generation, F.lit(0.0)), F.lit(0.0))
    i = F.greatest(F.coalesce(installed, F.lit(0.0)), F.lit(0.0))
    return F.when(i > 0, F.least(g, i)).otherwise(g)


def above_share(generation: Column, installed: Column, share: float = 0.0) -> Column:
    """Generation, or 0 when not above ``share`` of installed capacity."""
    if share <= 0:
        return generation
    limit = F.greatest(F.coalesce(installed, F.lit(0.0)), F.lit(0.0)) * share
    return F.when(generation > limit, generation).otherwise(F.lit(0.0))


__all__ = ["unit_hour_means", "positive_hours", "generation_bounds", "hours_in_windows", "counts_in_windows", "hours_col"]
