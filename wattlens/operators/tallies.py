"""Hour tallies, counting windows and the exclusion rules applied to them.

A tally row is an interval (``seg_start``, ``seg_end``) with per-hour values: full outage
hours are 0/1, equivalent hours are the derated share. Sums multiply by the hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.maths import floor0, num, nz, ratio
from ..functions.times import floor_hour, one_hour
from .rows import require, same_keys
from .runs import END, START, hours_col, mark_runs
from .timeline import cut_by, interval_sums, lowest, runs_of_hours

UNIT_KEYS = ["country", "plant_type_code", "plant_type", "eic_code", "unit_name"]
FULL = ["POH", "MOH", "FOH", "UOH", "SOH"]
PARTIAL = ["EPDH", "EMDH", "EFDH", "EUDH", "ESDH"]


def tally(panel: DataFrame) -> DataFrame:
    """Full and equivalent outage hours by class from the labelled panel."""
    inst = F.greatest(F.coalesce(num("installed_capacity"), F.lit(0.0)), F.lit(0.0))
    avail = floor0(num("avail_capacity"))
    st, ot, rs = (F.lower(F.coalesce(c, F.lit(""))) for c in ("state", "outage_type", "outage_reason"))
    d = panel.withColumn("installed_capacity", inst).withColumn("avail_capacity", avail)
    d = d.withColumn("is_active", F.col("installed_capacity") > 0)
    derate = F.least(floor0(F.coalesce(F.col("installed_capacity") - F.col("avail_capacity"), F.lit(0.0))), F.col("installed_capacity"))
    d = d.withColumn("derate_MW", derate)
    d = d.withColumn("ratio", F.coalesce(ratio("derate_MW", "installed_capacity"), F.lit(0.0)))
    down = F.col("is_active") & st.isin("out", "derate")
    m = down & (rs == "maintenance")
    u, s = down & (ot == "forced"), down & (ot == "planned")
    classes = {"P": s & ~m, "M": m, "F": u & ~m, "U": u, "S": s}
    full = (st == "out") & F.col("is_active")
    part = (st == "derate") & F.col("is_active") & (F.col("ratio") > 0) & (F.col("ratio") < 1 - 1e-12)
    cols = {f"{k}OH": (c & full).cast("int") for k, c in classes.items()}
    cols |= {f"E{k}DH": F.when(c & part, F.col("ratio")).otherwise(0.0) for k, c in classes.items()}
    return d.withColumns(cols).withColumn("state", F.when(st.isin("avail", "out", "derate"), st))


def dedup_units(panel: DataFrame, area: str = "area", area_order: list[str] | None = None,
                psr_order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep one (area, plant type) block per unit: most hours, then preference, then name.

    Returns the filtered panel and the removed combinations with their hours.
    """
    key = ["eic_code", area, "plant_type_code"]
    counts = panel.filter(F.col("eic_code").isNotNull() & F.col(area).isNotNull() & F.col("plant_type_code").isNotNull()
                          ).groupBy(*key).agg(F.sum(hours_col()).alias("n"))

    def rank(c: str, order: list[str] | None) -> Column:
        out = F.lit(len(order or []))
        for i, v in reversed(list(enumerate(order or []))):
            out = F.when(F.col(c) == v, i).otherwise(out)
        return out

    pick = F.min(F.struct((-F.col("n")).alias("n"), rank(area, area_order).alias("a"),
                          rank("plant_type_code", psr_order).alias("p"), F.col(area), F.col("plant_type_code")))
    keep = counts.groupBy("eic_code").agg(pick.alias("k")).select("eic_code", F.col(f"k.{area}").alias(area), "k.plant_type_code")
    removed = counts.join(keep, key, "left_anti").withColumnRenamed("n", "rows_removed")
    return panel.join(keep, key, "left_semi"), removed


def dedup_unit_hours(panel: DataFrame) -> DataFrame:
    """One row per unit and stretch of time: where two series of a unit overlap, the one with
    the lowest available capacity in every hour. Units with one series pass unchanged."""
    return lowest(panel, ["eic_code"], "avail_capacity")


def clip_intervals(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intersect rows with [start, end)."""
    d = df.withColumn(START, F.greatest(F.col(START), start)).withColumn(END, F.least(F.col(END), end))
    return d.filter(F.col(START) < F.col(END))


COUNTING_MODES = ("full", "outage-span", "first-generation", "generation-span")


def counting_windows(tallies: DataFrame, mode: str, bounds: DataFrame | None = None,
                     keys: list[str] | None = None) -> DataFrame:
    """Per unit: the window whose hours count, with the facts behind it.

    outage-span runs from the last hour of the first outage run to the last outage hour;
    first-generation widens it to the generating hours; generation-span is those alone.
    Units without outage (or, in the last mode, without generation) keep nothing.
    """
    require(mode, COUNTING_MODES, "mode")
    keys = keys or [k for k in UNIT_KEYS if k in tallies.columns]
    out_flag = F.coalesce(F.col("derate_MW") > 0, F.lit(False))
    d = mark_runs(tallies.withColumn("_o", out_flag), keys, F.col("_o"))
    runs = d.groupBy(*keys, "run_id", "_o").agg(
        F.min(START).alias("s"), F.max(END).alias("e"), F.sum(hours_col()).alias("n"))
    first_run = F.min(F.when(F.col("_o"), F.struct("s", "e")))
    u = runs.groupBy(*keys).agg(
        F.min("s").alias("first_timestamp"), (F.max("e") - one_hour()).alias("last_timestamp"),
        first_run.alias("_f"), F.max(F.when(F.col("_o"), F.col("e") - one_hour())).alias("last_outage_timestamp"),
        F.sum("n").alias("n_rows"))
    u = u.withColumn("first_outage_timestamp", F.col("_f.s")).withColumn(
        "first_outage_end_timestamp", F.col("_f.e") - one_hour()).drop("_f")
    gen = ["first_generation_timestamp", "last_generation_timestamp", "generation_hours"]
    if bounds is not None:
        u = u.join(bounds.select("eic_code", *gen), "eic_code", "left")
    else:
        u = u.withColumns({gen[0]: F.lit(None).cast("timestamp"), gen[1]: F.lit(None).cast("timestamp"), gen[2]: F.lit(None).cast("long")})
    known = F.col("generation_hours").isNotNull()
    s0, e0 = F.col("first_outage_end_timestamp"), F.col("last_outage_timestamp")
    if mode == "full":
        start, end, status = F.col("first_timestamp"), F.col("last_timestamp"), F.lit("full")
    elif mode == "generation-span":
        start, end = F.col(gen[0]), F.col(gen[1])
        status = F.when(known, "kept_generation_span").otherwise("no_generation_rows")
        blank = F.lit(None).cast("timestamp")
        u = u.withColumns({"first_outage_timestamp": blank, "first_outage_end_timestamp": blank, "last_outage_timestamp": blank})
    else:
        start, end, status = s0, e0, F.when(s0.isNull(), "no_outage_rows").otherwise("kept_window")
        if mode == "first-generation":
            start = F.when(s0.isNotNull(), F.least(s0, F.col(gen[0])))
            end = F.when(s0.isNotNull(), F.greatest(e0, F.col(gen[1])))
            status = F.when(s0.isNull(), "no_outage_rows").when(
                F.coalesce(F.col("generation_hours"), F.lit(0)) > 0, "kept_window_generation_extended"
            ).otherwise("kept_window_no_generation")
    u = u.withColumn("keep_start", start).withColumn("keep_end", end)
    span = (F.unix_seconds("keep_end") - F.unix_seconds("keep_start")) / 3600 + 1
    return u.withColumn("unit_counting_window", F.lit(mode)).withColumn(
        "period_hours", F.when(F.col("keep_end") >= F.col("keep_start"), F.floor(span)).otherwise(0).cast("long")
    ).withColumn("generation_hours", F.coalesce("generation_hours", F.lit(0)).cast("long")).withColumn("status", status)


def apply_windows(tallies: DataFrame, windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cut tallies to their unit's window; units without one disappear."""
    keys = keys or [k for k in UNIT_KEYS if k in tallies.columns]
    w = windows.filter(F.col("keep_start").isNotNull() & F.col("keep_end").isNotNull()).select(*keys, "keep_start", "keep_end")
    cond = None
    for k in keys:
        c = F.col(f"t.`{k}`").eqNullSafe(F.col(f"w.`{k}`"))
        cond = c if cond is None else cond & c
    d = tallies.alias("t").join(w.alias("w"), cond).select("t.*", "w.keep_start", "w.keep_end")
    return clip_intervals(d, F.col("keep_start"), F.col("keep_end") + one_hour()).drop("keep_start", "keep_end")


def window_report(tallies: DataFrame, windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Windows with the hours they keep and drop."""
    keys = keys or [k for k in UNIT_KEYS if k in tallies.columns]
    kept = apply_windows(tallies, windows, keys).groupBy(*keys).agg(F.sum(hours_col()).alias("kept_rows"))
    t = tallies.select(*keys, START, END).alias("t")
    w = windows.select(*keys, "keep_start", "keep_end").alias("w")
    cond = None
    for k in keys:
        c = F.col(f"t.`{k}`").eqNullSafe(F.col(f"w.`{k}`"))
        cond = c if cond is None else cond & c
    hrs = lambda a, b: F.greatest(F.floor((F.unix_seconds(b) - F.unix_seconds(a)) / 3600), F.lit(0))
    before = hrs(F.col(START), F.least(F.col(END), F.col("keep_start")))
    after = F.when(F.col("keep_end").isNull(), hrs(F.col(START), F.col(END))).otherwise(
        hrs(F.greatest(F.col(START), F.col("keep_end") + one_hour()), F.col(END)))
    sides = t.join(w, cond).groupBy(*[F.col(f"t.`{k}`") for k in keys]).agg(
        F.coalesce(F.sum(F.when(F.col("keep_start").isNotNull(), before)), F.lit(0)).alias("dropped_before_window_rows"),
        F.sum(after).alias("dropped_after_window_rows"))
    out = windows.join(sides, keys).join(kept, keys, "left")
    return out.withColumn("kept_rows", F.coalesce("kept_rows", F.lit(0))).withColumn(
        "dropped_rows", F.col("n_rows") - F.col("kept_rows"))


def unit_windows(tallies: DataFrame) -> DataFrame:
    """First and last retained hour per unit."""
    e = F.trim("eic_code")
    return tallies.filter(e != "").groupBy(e.alias("eic_code")).agg(
        F.min(START).alias("keep_start"), (F.max(END) - one_hour()).alias("keep_end"))


def outage_kind() -> Column:
    any_of = lambda a, b: (nz(a) > 0) | (nz(b) > 0)
    return (
        F.when(any_of("FOH", "EFDH"), "FO").when(any_of("MOH", "EMDH"), "MO").when(any_of("POH", "EPDH"), "PO")
        .when(any_of("SOH", "ESDH"), "SO").when(any_of("UOH", "EUDH"), "UO").otherwise("NONE")
    )


def long_outages(tallies: DataFrame, min_hours: int = 365 * 24, drop: bool = True,
                 keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs of one outage kind lasting at least ``min_hours``: (remaining tallies, report)."""
    keys = keys or ["country", "plant_type_code", "eic_code"]
    kind = F.when(nz("derate_MW") > 0, outage_kind()).otherwise("NONE")
    d = mark_runs(tallies.withColumn("_k", kind), keys, F.col("_k"))
    total = F.sum("_h").over(Window.partitionBy(*keys, "run_id"))
    d = d.withColumn("_h", hours_col()).withColumn("_run_h", total)
    hit = (F.col("_k") != "NONE") & (F.col("_run_h") >= min_hours)
    report = d.filter(hit).groupBy(*keys, "run_id", F.col("_k").alias("outage_type")).agg(
        F.min(START).alias("start"), F.max(END).alias("end_excl"),
        F.sum("_h").cast("double").alias("duration_h"), F.sum("_h").alias("n_rows")).drop("run_id")
    rest = d.filter(~hit).select(*tallies.columns) if drop else tallies
    return rest, report


def cluster_report(tallies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outage runs per unit with hours and MW sums."""
    from .runs import run_starts

    keys = keys or [k for k in UNIT_KEYS if k in tallies.columns]
    mw = floor0(nz("derate_MW"))
    d = run_starts(tallies.withColumn("_mw", mw), keys, {"o": F.col("_mw") > 0}).withColumn("_h", hours_col())
    on = F.col("o_on")
    return d.groupBy(*keys).agg(
        F.sum("_h").alias("n_rows"), F.coalesce(F.sum(F.when(on, F.col("_h"))), F.lit(0)).alias("outage_hours"),
        F.sum(F.col("o_start").cast("long")).alias("outage_cluster_count"),
        F.min(F.when(on, F.col(START))).alias("first_outage_timestamp"),
        F.max(F.when(on, F.col(END) - one_hour())).alias("last_outage_timestamp"),
        F.coalesce(F.sum(F.when(on, F.col("_mw") * F.col("_h"))), F.lit(0.0)).alias("derate_mw_hour_sum"),
        F.coalesce(F.max(F.when(on, F.col("_mw"))), F.lit(0.0)).alias("derate_mw_hour_max"))


def unit_inventory(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [k for k in UNIT_KEYS if k in panel.columns]
    return panel.groupBy(*keys).agg(F.sum(hours_col()).alias("panel_rows"), F.min(START).alias("panel_start"),
                                    (F.max(END) - one_hour()).alias("panel_end"))


def exclude(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    return rows.join(excluded.select("eic_code").filter("eic_code IS NOT NULL").distinct(), "eic_code", "left_anti")


def exclude_low_generation(panel: DataFrame, bounds: DataFrame, max_hours: float) -> tuple[DataFrame, DataFrame]:
    """Drop units whose positive generation hours do not exceed ``max_hours``."""
    rep = unit_inventory(panel).join(bounds, "eic_code", "left").withColumn(
        "generation_hours", F.coalesce("generation_hours", F.lit(0)).cast("long"))
    excluded = rep.filter(F.col("generation_hours") <= max_hours).withColumn(
        "exclude_reason", F.lit("generation_hours_le_threshold"))
    return exclude(panel, excluded), excluded


def exclude_rare_generation(tallies: DataFrame, windows: DataFrame, counts: DataFrame, min_frequency: float
                            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop units generating in less than ``min_frequency`` of their window's hours."""
    rep = windows.join(counts, "eic_code", "left").withColumn(
        "generation_hours_in_period", F.coalesce("generation_hours_in_period", F.lit(0)).cast("long"))
    rep = rep.withColumn("generation_frequency", F.coalesce(ratio("generation_hours_in_period", "period_hours"), F.lit(0.0)))
    bad = F.col("generation_frequency") < min_frequency
    excluded = rep.filter(bad).withColumn("exclude_reason", F.lit("generation_frequency_below_threshold"))
    return exclude(tallies, excluded), exclude(rep, excluded), excluded


def exclude_few_clusters(tallies: DataFrame, min_clusters: int) -> tuple[DataFrame, DataFrame]:
    """Drop units with fewer than ``min_clusters`` outage runs."""
    excluded = cluster_report(tallies).filter(F.col("outage_cluster_count") < min_clusters).withColumn(
        "exclude_reason", F.lit("outage_clusters_below_minimum"))
    return exclude(tallies, excluded), excluded


def _with_generation_flag(tallies: DataFrame, positive: DataFrame) -> DataFrame:
    """Tallies cut where a unit's runs of generating hours begin or end, with ``_gen``."""
    hours = positive.select(F.trim("eic_code").alias("e"), floor_hour("timestamp").alias("timestamp")).filter((F.col("e") != "") & F.col("timestamp").isNotNull()).distinct()
    cut = cut_by(tallies, runs_of_hours(hours, ["e"], []), {"e": F.trim(F.coalesce("eic_code", F.lit("")))}, [])
    return cut.withColumn("_gen", F.col("_run").isNotNull()).drop("_run")


def service_hours(tallies: DataFrame, positive: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """GSH = active, not fully out, generating. Returns (tallies with GSH, report per unit)."""
    keys = keys or [k for k in UNIT_KEYS if k in tallies.columns]
    h = _with_generation_flag(tallies, positive)
    free = F.col("is_active") & ((nz("POH") + nz("MOH") + nz("FOH")) <= 0)
    h = h.withColumn("_free", free).withColumn("GSH", (F.col("_free") & F.col("_gen")).cast("int"))
    n = lambda c: F.sum(F.when(c, hours_col()).otherwise(0))
    report = h.groupBy(*keys).agg(F.sum(hours_col()).alias("panel_rows"), n(F.col("is_active")).alias("active_hours"), n(F.col("_free")).alias("available_hours"),
                                  F.sum(F.coalesce("GSH", F.lit(0)) * hours_col()).alias("service_hours"))
    report = report.withColumn("reserve_shutdown_hours", F.greatest(F.col("available_hours") - F.col("service_hours"), F.lit(0)))
    return h.drop("_free", "_gen"), report


def economic_shutdown(tallies: DataFrame, positive: DataFrame, min_hours: int, keys: list[str] | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """RSH = runs of at least ``min_hours`` active hours without outage and without generation."""
    if min_hours <= 0:
        raise ValueError("min_hours must be positive")
    keys = keys or [k for k in UNIT_KEYS if k in tallies.columns]
    h = _with_generation_flag(tallies, positive)
    outage = nz("derate_MW") > 0
    for c in [*FULL, *PARTIAL]:
        outage = outage | (nz(c) > 0)
    cand = F.col("is_active") & ~outage & ~F.col("_gen") & (F.trim(F.coalesce("eic_code", F.lit(""))) != "")
    d = mark_runs(h.withColumn("_c", cand), keys, F.col("_c"))
    d = d.withColumn("_n", F.sum(hours_col()).over(Window.partitionBy(*keys, "run_id")))
    d = d.withColumn("economic_shutdown", F.col("_c") & (F.col("_n") >= min_hours))
    report = d.filter("economic_shutdown").groupBy(*keys, "run_id").agg(
        F.min(START).alias("start"), F.max(END).alias("end_excl"), F.sum(hours_col()).alias("duration_h"),
        F.sum(hours_col()).alias("n_rows")).drop("run_id").withColumn("economic_shutdown_min_hours", F.lit(min_hours))
    out = d.withColumn("RSH", F.col("economic_shutdown").cast("int")).drop("_c", "_n", "_gen", "run_id")
    return out, report


def input_qa(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per unit counters of the panel's hours: duplicates, gaps, missing and odd capacities.

    Works on intervals: rows and flags weighted by hours, and the distinct hours as the time
    that at least one interval covers. Rows without bounds count as one invalid hour.
    """
    keys = keys or ["country", "plant_type_code", "eic_code", "unit_name"]
    i, a = num("installed_capacity"), num("avail_capacity")
    valid = F.col(START).isNotNull() & F.col(END).isNotNull()
    h = F.when(valid, hours_col()).otherwise(1)
    flag = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), h).otherwise(0))
    rows = panel.groupBy(*keys).agg(
        F.coalesce(F.sum(h), F.lit(0)).alias("n_rows"), F.min(F.when(valid, F.col(START))).alias("timestamp_start"),
        (F.max(F.when(valid, F.col(END))) - one_hour()).alias("timestamp_end"), F.count_if(~valid).alias("invalid_timestamp_rows"),
        flag(i.isNull()).alias("missing_installed_capacity_hours"), flag(a.isNull()).alias("missing_avail_capacity_hours"),
        flag(i < 0).alias("negative_installed_capacity_hours"), flag(a < 0).alias("negative_avail_capacity_hours"),
        flag(a > i).alias("avail_gt_installed_hours"))
    spans = interval_sums(panel.filter(valid), keys, {}).groupBy(*keys).agg(F.sum(hours_col()).alias("n_unique_timestamps"))
    u = rows.alias("r").join(spans.alias("s"), same_keys("r", "s", keys), "left").select(
        *[F.col(f"r.`{c}`") for c in rows.columns], F.coalesce("n_unique_timestamps", F.lit(0)).cast("long").alias("n_unique_timestamps"))
    span = F.floor((F.unix_seconds("timestamp_end") - F.unix_seconds("timestamp_start")) / 3600) + 1
    return (
        u.withColumn("expected_hourly_timestamps", span)
        .withColumn("valid_timestamp_rows", F.col("n_rows") - F.col("invalid_timestamp_rows"))
        .withColumn("duplicate_timestamp_rows", F.greatest(F.col("valid_timestamp_rows") - F.col("n_unique_timestamps"), F.lit(0)))
        .withColumn("missing_hourly_timestamps", F.when(span.isNotNull(), F.greatest(span - F.col("n_unique_timestamps"), F.lit(0))))
        .withColumn("missing_avail_capacity_share", ratio("missing_avail_capacity_hours", "n_rows"))
        .withColumn("missing_installed_capacity_share", ratio("missing_installed_capacity_hours", "n_rows"))
    )


def input_qa_summary(by_unit: DataFrame) -> DataFrame:
    sums = ["n_rows", "valid_timestamp_rows", "duplicate_timestamp_rows", "missing_hourly_timestamps", "invalid_timestamp_rows",
            "missing_installed_capacity_hours", "missing_avail_capacity_hours", "negative_installed_capacity_hours",
            "negative_avail_capacity_hours", "avail_gt_installed_hours"]
    has = lambda c: F.coalesce(F.sum((c > 0).cast("long")), F.lit(0))
    odd = F.col("negative_installed_capacity_hours") + F.col("negative_avail_capacity_hours") + F.col("avail_gt_installed_hours")
    s = by_unit.agg(
        F.count(F.lit(1)).alias("n_units"), *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in sums],
        has(F.col("duplicate_timestamp_rows")).alias("units_with_duplicate_timestamps"),
        has(F.col("missing_hourly_timestamps")).alias("units_with_missing_hourly_timestamps"),
        has(F.col("missing_avail_capacity_hours")).alias("units_with_missing_avail_capacity"),
        has(odd).alias("units_with_capacity_corrections"))
    return s.withColumn("missing_avail_capacity_share", ratio("missing_avail_capacity_hours", "n_rows")).withColumn(
        "missing_installed_capacity_share", ratio("missing_installed_capacity_hours", "n_rows"))
