"""Availability panel against metered generation: factors, violations, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays
from ..functions.maths import floor0, num, nz, ratio
from ..functions.times import one_hour
from . import capacity as cap
from .generation import above_share, capped, tolerance
from .overlap import match_hours, overlap_join
from .rows import best_row
from .runs import END, START, hours_col, mark_runs
from .segments import to_hours
from .timeline import interval_sums

GROUP = ["country", "plant_type"]


def compared_capacity(panel: DataFrame, lookup: DataFrame | None = None, zero_below: float = 0.0) -> DataFrame:
    """Panel intervals with ``cmp_installed`` and ``cmp_available``.

    With a lookup, installed capacity is the external one in force: intervals are cut at
    its changes, and the parts without external capacity drop out. Without one, the
    panel's own capacity is used. Availability is clipped to [0, installed] and set to 0
    at or below ``zero_below`` of it.
    """
    own = floor0(num("avail_capacity"))
    if lookup is None:
        d = panel.withColumn("cmp_installed", num("installed_capacity")).withColumn("capacity_from_unit_table", F.lit(False))
    else:
        units = panel.groupBy(F.trim("eic_code").alias("unit_eic")).agg(
            F.max(F.upper(F.coalesce("asset_type", F.lit(""))) == "PRODUCTION").alias("is_plant_level"),
            *[F.min(c).alias(c) for c in ("country", "plant_type", "unit_name")])
        iv = cap.choose_keys(units, lookup).join(lookup, ["key_kind", "key"]).select(
            F.col("unit_eic").alias("_u"), "valid_from", "valid_to", F.col("mw").alias("cmp_installed"))
        iv = cap.close_intervals(iv, ["_u"]).withColumn("_ve", F.coalesce("valid_to", F.lit("2200-01-01").cast("timestamp")))
        lo, hi = F.col(START), F.col(END)
        j = panel.withColumn("_u", F.trim("eic_code")).join(iv, "_u").filter(
            (lo < F.col("_ve")) & (F.col("valid_from") < hi) & (F.col("cmp_installed") > 0))
        d = j.withColumn(START, F.greatest(START, "valid_from")).withColumn(END, F.least(END, "_ve")).drop(
            "_u", "valid_from", "valid_to", "_ve").withColumn("capacity_from_unit_table", F.lit(True))
    inst = F.col("cmp_installed")
    av = F.least(F.greatest(F.coalesce(own, inst), F.lit(0.0)), inst)
    if zero_below > 0:
        av = F.when(av <= inst * zero_below, 0.0).otherwise(av)
    return d.withColumn("cmp_available", av).filter(inst > 0)


def restricted(d: DataFrame, share: float = 0.0) -> DataFrame:
    """Intervals whose capacity is restricted by more than ``share`` of installed."""
    rep = F.when(F.col("installed_capacity") > 0, floor0(F.col("installed_capacity") - F.col("avail_capacity")))
    d = d.withColumn("reported_derated_mw", rep).withColumn("cmp_derated_mw", floor0(F.col("cmp_installed") - F.col("cmp_available")))
    return d.filter(F.coalesce("cmp_derated_mw", "reported_derated_mw") > nz("cmp_installed") * share)


CLUSTER_KEYS = ["country", "area", "plant_type", "eic_code"]


def restriction_clusters(d: DataFrame) -> DataFrame:
    """Number contiguous hours with one restriction signature and add their bounds."""
    sig = F.struct("outage_id", "state", "outage_type", "outage_reason", F.round("installed_capacity", 6).alias("i"),
                   F.round("avail_capacity", 6).alias("a"))
    m = mark_runs(d, CLUSTER_KEYS, sig, "cluster_seq")
    uid = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in CLUSTER_KEYS], F.col("cluster_seq").cast("string"))
    m = m.withColumn("outage_cluster_uid", uid)
    b = m.groupBy("outage_cluster_uid").agg(
        F.min(START).alias("outage_cluster_start"), F.max(END).alias("outage_cluster_end_excl"),
        F.sum(hours_col()).alias("outage_cluster_duration_h"))
    return m.join(b, "outage_cluster_uid")


def cluster_summary(d: DataFrame) -> DataFrame:
    one = lambda c: F.min(c).alias(c)
    h = hours_col()
    return d.groupBy("outage_cluster_uid").agg(
        *[one(c) for c in (*CLUSTER_KEYS, "unit_name", "outage_cluster_start", "outage_cluster_end_excl", "outage_cluster_duration_h")],
        F.sum(h).alias("active_unit_hours"),
        F.min("avail_capacity").alias("min_available_capacity_mw"), F.max("avail_capacity").alias("max_available_capacity_mw"),
        F.min("installed_capacity").alias("min_installed_capacity_mw"), F.max("installed_capacity").alias("max_installed_capacity_mw"),
        (F.sum(F.col("reported_derated_mw") * h) / F.sum(h)).alias("mean_reported_derated_mw"),
        F.max("reported_derated_mw").alias("max_reported_derated_mw"),
        arrays.text_set("outage_id", ";").alias("outage_ids"), arrays.text_set("state", ";").alias("states"),
        arrays.text_set("outage_type", ";").alias("outage_types"), arrays.text_set("outage_reason", ";").alias("outage_reasons"))


def drop_long_clusters(d: DataFrame, max_days: float | None) -> tuple[DataFrame, DataFrame]:
    """Remove clusters longer than ``max_days``: (kept, summary of removed)."""
    c = restriction_clusters(d)
    if not max_days or max_days <= 0:
        return c, cluster_summary(c.filter(F.lit(False)))
    long = F.col("outage_cluster_duration_h") > max_days * 24
    return c.filter(~long), cluster_summary(c.filter(long))


def compare_hours(panel: DataFrame, generation: DataFrame, tol_mw: float = 0.0, tol_rel: float = 0.0,
                  min_share: float = 0.0) -> DataFrame:
    """Unit-hours with a reading: generation used, tolerance and excess over availability."""
    g = generation.filter(F.col("actual_generation_mw").isNotNull()).withColumnRenamed("area_code", "generation_area_code") \
        if "area_code" in generation.columns else generation.filter(F.col("actual_generation_mw").isNotNull())
    m = match_hours(g, panel)
    inst = F.col("cmp_installed")
    raw = F.greatest(nz("actual_generation_mw"), F.lit(0.0))
    m = m.withColumn("actual_generation_mw", raw).withColumn("actual_generation_capped_mw", capped(raw, inst))
    used = above_share(F.col("actual_generation_capped_mw"), inst, min_share)
    return (
        m.withColumn("actual_generation_used_mw", used)
        .withColumn("generation_above_installed_mw", F.col("actual_generation_mw") - F.col("actual_generation_capped_mw"))
        .withColumn("generation_min_threshold_mw", nz(inst) * float(min_share))
        .withColumn("generation_availability_tolerance_mw", tolerance(inst, tol_mw, tol_rel))
        .withColumn("excess_generation_mw", F.col("actual_generation_used_mw") - F.col("cmp_available"))
        .withColumn("is_violation", F.col("excess_generation_mw") > F.col("generation_availability_tolerance_mw"))
        .withColumn("excess_generation_above_tolerance_mw",
                    floor0(F.col("excess_generation_mw") - F.col("generation_availability_tolerance_mw")))
        .withColumn("generation_factor_pct", 100.0 * ratio("actual_generation_used_mw", "cmp_installed"))
        .withColumn("availability_factor_pct", 100.0 * ratio("cmp_available", "cmp_installed"))
        .withColumn("excess_generation_factor_pct", 100.0 * ratio("excess_generation_mw", "cmp_installed"))
        .withColumn("year", F.year("timestamp")).withColumn("date", F.to_date("timestamp"))
    )


def violation_hours(panel: DataFrame, generation: DataFrame, tol_mw: float = 0.0, tol_rel: float = 0.0,
                    min_share: float = 0.0) -> DataFrame:
    return compare_hours(panel, generation, tol_mw, tol_rel, min_share).filter("is_violation").drop("is_violation")


UNIT_YEAR = ["asset_type", "country", "plant_type", "eic_code", "year"]
ADDITIVE = ["availability_unit_hours", "availability_installed_capacity_mwh", "observed_generation_unit_hours",
            "violation_unit_hours", "generation_mwh", "raw_generation_mwh", "generation_clipped_mwh",
            "observed_available_capacity_mwh", "observed_installed_capacity_mwh", "excess_generation_mwh"]


def _shares(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("violation_share_of_observed_hours", ratio("violation_unit_hours", "observed_generation_unit_hours"))
        .withColumn("generation_coverage_share", ratio("observed_generation_unit_hours", "availability_unit_hours"))
    )


def unit_year_summary(panel: DataFrame, compared: DataFrame) -> DataFrame:
    """Population and violation measures per unit and year (key NULLs match)."""
    h = hours_col()
    pop = panel.withColumn("year", F.year(START)).groupBy(*UNIT_YEAR).agg(
        F.sum(h).alias("availability_unit_hours"),
        F.sum(F.col("cmp_installed") * h).alias("availability_installed_capacity_mwh"))
    v = F.col("is_violation")
    comp = compared.groupBy(*UNIT_YEAR).agg(
        F.count(F.lit(1)).alias("observed_generation_unit_hours"), F.sum(v.cast("long")).alias("violation_unit_hours"),
        F.sum("actual_generation_used_mw").alias("generation_mwh"), F.sum("actual_generation_mw").alias("raw_generation_mwh"),
        F.sum("generation_above_installed_mw").alias("generation_clipped_mwh"),
        F.sum("cmp_available").alias("observed_available_capacity_mwh"),
        F.sum("cmp_installed").alias("observed_installed_capacity_mwh"),
        F.sum(F.when(v, floor0("excess_generation_mw")).otherwise(0.0)).alias("excess_generation_mwh"),
        F.max("excess_generation_mw").alias("max_excess_generation_mw"),
        F.max("generation_factor_pct").alias("max_generation_factor_pct"),
        F.min("availability_factor_pct").alias("min_availability_factor_pct"))
    from .rows import same_keys

    j = pop.alias("p").join(comp.alias("c"), same_keys("p", "c", UNIT_YEAR), "left").select(
        "p.*", *[F.col(f"c.`{c}`") for c in comp.columns if c not in UNIT_YEAR])
    zero = [c for c in ADDITIVE if c in comp.columns] + ["max_excess_generation_mw"]
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(comp.schema[c].dataType) for c in zero})
    return _shares(j.withColumn("has_generation_observations", F.col("observed_generation_unit_hours") > 0))


def roll_up(unit_year: DataFrame, keys: list[str]) -> DataFrame:
    """Unit-year rows summed to coarser keys; units are counted exactly."""
    g = unit_year.groupBy(*keys).agg(
        F.count_distinct("eic_code").alias("n_units"),
        F.count_distinct(F.when(F.col("has_generation_observations"), F.col("eic_code"))).alias("n_units_with_generation"),
        F.count_distinct(F.when(F.col("violation_unit_hours") > 0, F.col("eic_code"))).alias("n_units_with_violations"),
        *[F.sum(c).alias(c) for c in ADDITIVE],
        F.max("max_excess_generation_mw").alias("max_excess_generation_mw"))
    return _shares(g)


def monthly_violations(hours: DataFrame) -> DataFrame:
    return hours.groupBy("country", "plant_type", F.date_trunc("month", "timestamp").alias("month")).agg(
        F.count(F.lit(1)).alias("violation_unit_hours"), F.count_distinct("eic_code").alias("n_units"),
        F.sum("excess_generation_above_tolerance_mw").alias("excess_generation_mwh"),
        F.max("excess_generation_mw").alias("max_excess_generation_mw"))


def _factors(d: DataFrame) -> DataFrame:
    return (
        d.withColumn("availability_factor_pct", 100.0 * ratio("available_mw", "installed_mw"))
        .withColumn("generation_factor_pct", 100.0 * ratio("generation_mw", "installed_mw"))
        .withColumn("generation_coverage_share", ratio("observed_generation_unit_hours", "unit_hours"))
    )


def availability_intervals(panel: DataFrame) -> DataFrame:
    """Availability sums per country and type, as intervals in which they are constant."""
    sums = {"installed_mw": "cmp_installed", "available_mw": "cmp_available", "report_installed_mw": "installed_capacity", "report_available_mw": "avail_capacity"}
    return interval_sums(panel, GROUP, {k: F.col(c) for k, c in sums.items()}, nullable=tuple(sums), count="unit_hours")


def hourly_availability(panel: DataFrame) -> DataFrame:
    """Availability sums per country, type and hour: group-hours, made from prefix sums."""
    return to_hours(availability_intervals(panel))


def availability_vs_generation(panel: DataFrame, generation: DataFrame, tol_mw: float = 0.0, tol_rel: float = 0.0,
                               min_share: float = 0.0, compared: DataFrame | None = None) -> DataFrame:
    """Hourly factors over the panel's hours (all, or only the restricted ones passed in).

    Two aggregates on the same small key are joined, never the two fact tables row by row.
    ``compared``: the result of ``compare_hours`` where it is at hand.
    """
    c = compare_hours(panel, generation, tol_mw, tol_rel, min_share) if compared is None else compared
    g = c.groupBy(*GROUP, "timestamp").agg(
        F.sum("actual_generation_used_mw").alias("generation_mw"), F.sum("actual_generation_mw").alias("raw_generation_mw"),
        F.sum("generation_above_installed_mw").alias("generation_clipped_mw"),
        F.sum(F.when(F.col("is_violation"), floor0("excess_generation_mw")).otherwise(0.0)).alias("generation_gt_available_mw"),
        F.count(F.lit(1)).alias("observed_generation_unit_hours"))
    h = hourly_availability(panel).join(g, [*GROUP, "timestamp"], "left")
    zero = ["generation_mw", "raw_generation_mw", "generation_clipped_mw", "generation_gt_available_mw", "observed_generation_unit_hours"]
    h = h.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(g.schema[c].dataType) for c in zero})
    return _factors(_cap_sum(h))


def _cap_sum(h: DataFrame) -> DataFrame:
    cut = F.least(floor0("generation_mw"), floor0("installed_mw"))
    h = h.withColumn("_cut", cut)
    return h.withColumn("generation_clipped_mw", nz("generation_clipped_mw") + floor0(F.col("generation_mw") - F.col("_cut"))).withColumn(
        "generation_mw", F.col("_cut")).drop("_cut")


def daily(hourly: DataFrame) -> DataFrame:
    """Days from hours: MW averaged over hours, unit-hours summed, units at their maximum."""
    mean = [c for c in ("installed_mw", "available_mw", "report_installed_mw", "report_available_mw", "generation_mw", "raw_generation_mw",
                        "generation_clipped_mw", "generation_gt_available_mw", "generation_only_installed_mw") if c in hourly.columns]
    total = [c for c in ("unit_hours", "observed_generation_unit_hours", "synthetic_availability_unit_hours") if c in hourly.columns]
    d = hourly.groupBy(*GROUP, F.to_date("timestamp").alias("date")).agg(
        *[F.avg(c).alias(c) for c in mean], *[F.sum(c).alias(c) for c in total],
        F.max("unit_hours").alias("n_units"), F.max("observed_generation_unit_hours").alias("n_units_with_generation"))
    return _factors(d)


def full_unit_series(panel: DataFrame, generation: DataFrame, lookup: DataFrame | None = None, unit_meta: DataFrame | None = None,
                     min_share: float = 0.0, cap_external_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Availability and generation over all units, including generating units without panel.

    A generation-only unit with known capacity counts as fully available in its observed
    hours. Returns (hourly, summary of generation-only units). With ``cap_external_only``
    generation is capped by the lookup alone.
    """
    gen = generation.filter(F.col("actual_generation_mw").isNotNull()).select(
        "timestamp", "eic_code", F.greatest("actual_generation_mw", F.lit(0.0)).alias("raw_generation_mw"))
    have = panel.select(*GROUP, "eic_code", START, END, "cmp_installed")
    matched = match_hours(gen, have).select("timestamp", "eic_code", F.col("cmp_installed").alias("panel_mw"))
    g = gen.join(matched.groupBy("timestamp", "eic_code").agg(F.max("panel_mw").alias("panel_mw")), ["timestamp", "eic_code"], "left")
    if lookup is not None:
        g = cap.attach_capacity(g.withColumnRenamed("eic_code", "unit_eic"), lookup, "timestamp", allow_name=False,
                                out="ext_mw").withColumnRenamed("unit_eic", "eic_code")
    else:
        g = g.withColumn("ext_mw", F.lit(None).cast("double"))
    own = F.lit(None).cast("double") if cap_external_only else F.when(F.col("panel_mw") > 0, F.col("panel_mw"))
    g = g.withColumn("cap_mw", F.coalesce(own, "ext_mw"))
    g = g.withColumn("generation_mw", above_share(capped(F.col("raw_generation_mw"), F.col("cap_mw")), F.col("cap_mw"), min_share))
    g = g.withColumn("generation_clipped_mw", F.col("raw_generation_mw") - capped(F.col("raw_generation_mw"), F.col("cap_mw")))
    meta = panel.groupBy("eic_code").agg(F.min(F.struct(*GROUP)).alias("m")).select("eic_code", "m.*", F.lit(True).alias("in_panel"))
    g = g.join(meta, "eic_code", "left")
    if unit_meta is not None:
        um = unit_meta.select("eic_code", F.col("country").alias("_c"), F.col("plant_type").alias("_t"))
        g = g.join(um, "eic_code", "left").withColumn("country", F.coalesce("country", "_c")).withColumn(
            "plant_type", F.coalesce("plant_type", "_t")).drop("_c", "_t")
    only = F.col("in_panel").isNull()
    g = g.withColumn("only", only).withColumn("synthetic", only & F.coalesce(F.col("cap_mw") > 0, F.lit(False)))
    placed = g.filter(F.col("country").isNotNull() & F.col("plant_type").isNotNull())
    hg = placed.groupBy(*GROUP, "timestamp").agg(
        F.sum("generation_mw").alias("generation_mw"), F.sum("raw_generation_mw").alias("raw_generation_mw"),
        F.sum("generation_clipped_mw").alias("generation_clipped_mw"), F.count(F.lit(1)).alias("observed_generation_unit_hours"),
        F.sum(F.when(F.col("synthetic"), F.col("cap_mw")).otherwise(0.0)).alias("generation_only_installed_mw"),
        F.sum(F.col("synthetic").cast("long")).alias("synthetic_availability_unit_hours"),
        F.sum((only & ~F.col("synthetic")).cast("long")).alias("generation_only_units_missing_capacity"))
    h = hourly_availability(panel).join(hg, [*GROUP, "timestamp"], "full")
    h = h.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(h.schema[c].dataType) for c in h.columns if c not in (*GROUP, "timestamp")})
    for c in ("installed_mw", "available_mw"):
        h = h.withColumn(c, F.col(c) + F.col("generation_only_installed_mw"))
    h = h.withColumn("unit_hours", F.col("unit_hours") + F.col("synthetic_availability_unit_hours"))
    h = _factors(_cap_sum(h)).withColumn("generation_gt_available_mw", floor0(F.col("generation_mw") - F.col("available_mw")))
    summary = g.filter("only").groupBy("eic_code").agg(
        F.min("country").alias("country"), F.min("plant_type").alias("plant_type"), F.min("timestamp").alias("first_generation_hour"),
        F.max("timestamp").alias("last_generation_hour"), F.count(F.lit(1)).alias("observed_generation_hours"),
        F.sum("generation_mw").alias("generation_mwh"), F.sum("raw_generation_mw").alias("raw_generation_mwh"),
        F.sum("generation_clipped_mw").alias("generation_clipped_mwh"),
        F.sum((~F.col("synthetic")).cast("long")).alias("missing_capacity_hours"))
    return h, summary


def daily_summary(day: DataFrame) -> DataFrame:
    """Measures over all days of a country and type."""
    share = ratio("observed_generation_unit_hours", "unit_hours")
    return day.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("installed_mw").alias("mean_installed_mw"), F.max("installed_mw").alias("max_installed_mw"),
        F.avg("availability_factor_pct").alias("mean_availability_factor_pct"), F.min("availability_factor_pct").alias("min_availability_factor_pct"),
        F.avg("generation_factor_pct").alias("mean_generation_factor_pct"),
        F.min("installed_mw").alias("min_installed_mw"), F.max("n_units").alias("max_units"), F.max("n_units_with_generation").alias("max_units_with_generation"),
        F.avg(share).alias("mean_generation_coverage"), F.max("generation_gt_available_mw").alias("max_generation_gt_available_mw"),
        F.count_if(F.col("generation_gt_available_mw") > 0).alias("days_generation_gt_availability"))


SEGMENT_KEYS = ["country", "asset_type", "area", "plant_type", "eic_code", "unit_name"]


def segment_id(start: str = "segment_start_utc") -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("country", "asset_type", "plant_type_code", "eic_code")],
                       F.date_format(start, "yyyyMMddHH"))


def violation_segments(hours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contiguous violating hours of a unit: (segments, hours with their segment_id).

    Hours are reduced to one row per unit-hour before the window, the one with the largest
    excess: a unit with two series or a double reading has one run, not two broken ones.
    """
    hours = best_row(hours, [*SEGMENT_KEYS, "timestamp"], [F.coalesce("excess_generation_above_tolerance_mw", F.lit(-1.0))])
    h = hours.drop(START, END).withColumn(START, F.col("timestamp")).withColumn(END, F.col("timestamp") + one_hour())
    m = mark_runs(h, SEGMENT_KEYS, F.lit(1), "_seq")
    seg = m.groupBy(*SEGMENT_KEYS, "_seq").agg(
        F.min("plant_type_code").alias("plant_type_code"), F.min("timestamp").alias("segment_start_utc"),
        F.max(END).alias("segment_end_utc"), F.count(F.lit(1)).alias("violation_hours"),
        arrays.text_set("outage_id").alias("current_outage_ids"), arrays.text_set("state").alias("current_states"),
        arrays.text_set("outage_type").alias("current_outage_types"), arrays.text_set("outage_reason").alias("current_outage_reasons"),
        F.max("installed_capacity").alias("max_report_installed_capacity_mw"),
        F.min("avail_capacity").alias("min_report_available_capacity_mw"),
        F.max("cmp_installed").alias("max_comparison_installed_capacity_mw"),
        F.min("cmp_available").alias("min_comparison_available_capacity_mw"),
        F.max("actual_generation_mw").alias("max_actual_generation_mw"),
        F.max("actual_generation_capped_mw").alias("max_actual_generation_capped_mw"),
        F.max("generation_above_installed_mw").alias("max_generation_above_installed_mw"),
        F.sum("excess_generation_above_tolerance_mw").alias("sum_excess_generation_above_tolerance_mwh"))
    seg = seg.withColumn("segment_duration_h", (F.unix_seconds("segment_end_utc") - F.unix_seconds("segment_start_utc")) / 3600.0)
    seg = seg.withColumn("segment_id", segment_id())
    ids = seg.select(*SEGMENT_KEYS, "_seq", "segment_id")
    cond = None
    for k in (*SEGMENT_KEYS, "_seq"):
        c = F.col(f"h.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
        cond = c if cond is None else cond & c
    tagged = m.alias("h").join(ids.alias("s"), cond).select("h.*", "s.segment_id").drop("_seq", START, END)
    return seg.drop("_seq"), tagged


__all__ = ["overlap_join"]
