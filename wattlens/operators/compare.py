"""Two panels side by side, published reference values, and source-against-source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.maths import floor0, num, nz, ratio, weighted_mean
from ..session import materialise
from .panel import outage_parts
from .quantiles import quantiles, with_quantiles
from .rows import same_keys
from .runs import END, START, hours_col, merge_runs
from .timeline import interval_sums

KEYS = ["country", "plant_type_code", "month"]
UNIT_KEYS = ["country", "plant_type_code", "eic_code"]
TYPE_LABELS = ["planned_outage_mwh", "forced_outage_mwh", "unknown_type_outage_mwh"]
REASON_LABELS = ["maintenance_outage_mwh", "nonmaintenance_outage_mwh"]
MEASURES = ["outage_mwh", *TYPE_LABELS, *REASON_LABELS]


def _mw(panel: DataFrame) -> DataFrame:
    """MW by label for one side of a comparison."""
    out = outage_parts(panel, use_rules=False)["outage"]
    t, r = (F.lower(F.coalesce(c, F.lit(""))) for c in ("outage_type", "outage_reason"))
    d = panel.withColumn("outage_mwh", out).withColumn("month", F.date_format(START, "yyyy-MM"))
    o = F.col("outage_mwh")
    return d.withColumns({
        "planned_outage_mwh": F.when(t == "planned", o).otherwise(0.0), "forced_outage_mwh": F.when(t == "forced", o).otherwise(0.0),
        "unknown_type_outage_mwh": F.when(~t.isin("planned", "forced"), o).otherwise(0.0),
        "maintenance_outage_mwh": F.when(r == "maintenance", o).otherwise(0.0), "nonmaintenance_outage_mwh": F.when(r != "maintenance", o).otherwise(0.0)})


def monthly_side(panel: DataFrame) -> DataFrame:
    """Monthly energy by label and mean fleet capacity (fleet sums per stretch, weighted by hours)."""
    d, h = _mw(panel), hours_col()
    rows = d.groupBy(*KEYS).agg(F.sum(h).alias("unit_hours"), F.count_distinct("eic_code").alias("unit_count"),
                                *[F.sum(F.col(c) * h).alias(c) for c in MEASURES])
    fleet = interval_sums(d, KEYS, {"i": F.col("installed_capacity"), "a": F.col("avail_capacity")}, nullable=("i", "a"))
    mean = lambda c: F.sum(F.col(c) * h) / F.sum(F.when(F.col(c).isNotNull(), h))
    caps = fleet.groupBy(*KEYS).agg(F.sum(h).alias("timestamp_hours"), mean("i").alias("installed_mw_mean"), mean("a").alias("available_mw_mean"),
                                    F.min("i").alias("installed_mw_min"), F.max("i").alias("installed_mw_max"))
    return rows.join(caps, KEYS).withColumn("availability_factor_pct", 100.0 * ratio("available_mw_mean", "installed_mw_mean"))


def unit_side(panel: DataFrame) -> DataFrame:
    d, h = _mw(panel), hours_col()
    return d.groupBy(*UNIT_KEYS).agg(
        F.sum(h).alias("unit_hours"), F.min(START).alias("timestamp_start"), F.max(START).alias("timestamp_last"),
        F.min("installed_capacity").alias("installed_mw_min"), (F.sum(F.col("installed_capacity") * h) / F.sum(h)).alias("installed_mw_mean"),
        F.max("installed_capacity").alias("installed_mw_max"), *[F.sum(F.col(c) * h).alias(c) for c in MEASURES])


def compare_sides(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Full outer comparison: presence, deltas, relative deltas, label shares and their shift."""
    j = old.select(*keys, *metrics).alias("a").join(new.select(*keys, *metrics).alias("b"), same_keys("a", "b", keys), "full")
    pa, pb = F.col(f"a.{metrics[0]}").isNotNull(), F.col(f"b.{metrics[0]}").isNotNull()
    d = j.select(*[F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in keys], pa.alias("present_in_old"), pb.alias("present_in_new"),
                 *[F.col(f"a.`{m}`").alias(f"{m}_old") for m in metrics], *[F.col(f"b.`{m}`").alias(f"{m}_new") for m in metrics])
    for m in metrics:
        d = d.withColumn(f"{m}_delta", nz(f"{m}_new") - nz(f"{m}_old"))
        d = d.withColumn(f"{m}_pct_delta_vs_old", F.when(F.col(f"{m}_old") != 0, F.col(f"{m}_delta") / F.col(f"{m}_old")))
    if "outage_mwh" in metrics:
        share = lambda m, s: F.when(F.col(f"outage_mwh_{s}") != 0, F.col(f"{m}_{s}") / F.col(f"outage_mwh_{s}"))
        for m in [x for x in (*TYPE_LABELS, *REASON_LABELS) if x in metrics]:
            p = m.removesuffix("_outage_mwh")
            d = d.withColumn(f"{p}_share_old", share(m, "old")).withColumn(f"{p}_share_new", share(m, "new"))
            d = d.withColumn(f"{p}_share_delta", nz(f"{p}_share_new") - nz(f"{p}_share_old"))
        total = lambda ms: sum((F.abs(F.col(f"{m}_delta")) for m in ms if m in metrics), F.lit(0.0))
        d = d.withColumn("abs_outage_mwh_delta", F.abs("outage_mwh_delta")).withColumn("abs_type_delta_mwh", total(TYPE_LABELS)).withColumn(
            "abs_reason_delta_mwh", total(REASON_LABELS))
        d = d.withColumn("abs_label_delta_mwh", F.col("abs_type_delta_mwh") + F.col("abs_reason_delta_mwh"))
        d = d.withColumn("abs_label_delta_share_of_old_outage", F.when(F.col("outage_mwh_old") != 0, F.col("abs_label_delta_mwh") / F.col("outage_mwh_old")))
    return d


def _as_runs(df: DataFrame, start: str, end: str, keys: list[str], labels: list[str]) -> DataFrame:
    d = df.withColumnsRenamed({start: START, end: END}).withColumn("_m", F.date_trunc("month", START))
    return materialise(merge_runs(d, [*keys, "_m"], labels).drop("_m")).withColumnsRenamed({START: start, END: end})


def label_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Outage energy whose type or reason label differs between two interval panels."""
    from .overlap import overlap_join

    a = _mw(old).select("eic_code", "country", "plant_type_code", F.col(START).alias("a0"), F.col(END).alias("a1"), "outage_mwh",
                        F.lower(F.coalesce("outage_type", F.lit(""))).alias("t0"), F.lower(F.coalesce("outage_reason", F.lit(""))).alias("r0")).filter("outage_mwh > 0")
    b = new.select("eic_code", F.col(START).alias("b0"), F.col(END).alias("b1"),
                   F.lower(F.coalesce("outage_type", F.lit(""))).alias("t1"), F.lower(F.coalesce("outage_reason", F.lit(""))).alias("r1"))
    # touching intervals of equal labels that begin in one month count as one; each side is read three times
    a = _as_runs(a, "a0", "a1", ["eic_code"], ["country", "plant_type_code", "outage_mwh", "t0", "r0"])
    b = _as_runs(b, "b0", "b1", ["eic_code"], ["t1", "r1"])
    j = overlap_join(a, b, ["eic_code"], ("a0", "a1"), ("b0", "b1"), looked_up=True)
    e = F.col("outage_mwh") * (F.unix_seconds(F.least("a1", "b1")) - F.unix_seconds(F.greatest("a0", "b0"))) / 3600.0
    dt, dr = F.col("t0") != F.col("t1"), F.col("r0") != F.col("r1")
    return j.withColumn("e", e).withColumn("month", F.date_format(F.greatest("a0", "b0"), "yyyy-MM")).groupBy(*KEYS).agg(
        F.sum(F.when(dt | dr, F.col("e")).otherwise(0.0)).alias("changed_mwh"), F.sum(F.when(dt, F.col("e")).otherwise(0.0)).alias("type_changed_mwh"),
        F.sum(F.when(dr, F.col("e")).otherwise(0.0)).alias("reason_changed_mwh"))


def matching_partitions(old: DataFrame, new: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return {"common": a.intersect(b), "missing_in_new": a.exceptAll(b), "missing_in_old": b.exceptAll(a)}


def compare_panels(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    return {
        "monthly": compare_sides(monthly_side(old), monthly_side(new), KEYS, ["unit_hours", *MEASURES]),
        "units": compare_sides(unit_side(old), unit_side(new), UNIT_KEYS, ["unit_hours", *MEASURES]),
        "label_changes": label_changes(old, new),
        **{f"partitions_{k}": v for k, v in matching_partitions(old, new, ["country", "plant_type_code"]).items()},
    }


# --- published reference values ---------------------------------------------------------

HOURS = ["acth", "poh", "moh", "foh", "uoh", "soh", "epdh", "emdh", "efdh", "eudh", "esdh"]


def annual_from_monthly(monthly: DataFrame) -> DataFrame:
    """Annual fleet KPIs from monthly ones. Service hours are active minus planned hours here,
    and equivalent rates divide by service plus strict hours only; both differ from the
    fleet table on purpose and are kept as a separate method."""
    d = lower_names(monthly)
    d = d.filter(F.col("period_key").rlike(r"^\d{4}-\d{2}$")).withColumn("period_key", F.substring("period_key", 1, 4))
    weighted = [c for c in d.columns if c[:1] == "w" and c[1:].endswith(("af", "of", "or"))]
    g = d.groupBy("country", "plant_type", "period_key").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in HOURS if c in d.columns],
        *[F.max(c).alias(c) for c in ("n_units", "cap_total_mw") if c in d.columns], *[weighted_mean(c, "acth").alias(c) for c in weighted])
    act, sh = F.col("acth"), F.col("acth") - F.col("soh")
    esh = act - (F.col("soh") + F.col("esdh"))
    div = lambda a, b: F.when(b != 0, a / b)
    g = g.withColumns({"sh": sh, "esh": esh, "uaf": div(sh, act), "ueaf": div(esh, act)})
    for k in "pmfus":
        full, part = F.col(f"{k}oh"), F.col(f"e{k}dh")
        g = g.withColumns({f"u{k}of": div(full, act), f"ue{k}of": div(full + part, act), f"u{k}or": div(full, F.col("sh") + full),
                           f"ue{k}or": div(full + part, F.col("sh") + full)})
    return g


def annual_rows(kpis: DataFrame) -> DataFrame:
    return kpis.filter(F.col("period_key").rlike(r"^\d{4}$"))


def outage_days(kpis: DataFrame) -> DataFrame:
    """Capacity-weighted outage days from factors, with leap years."""
    kpis = lower_names(kpis)
    y = F.expr("try_cast(period_key as int)")
    days = F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 366.0).otherwise(365.0)
    out = kpis
    for k in "PSMFU":
        for e in ("", "e"):
            c = f"w{e}{k.lower()}of"
            if c in kpis.columns:
                out = out.withColumn(f"{e.upper()}{k}OD", F.col(c) * days)
        if {f"{k}OD", f"E{k}OD"} <= set(out.columns):
            out = out.withColumn(f"E{k}DH_days", floor0(F.col(f"E{k}OD") - F.col(f"{k}OD")))
    return out


def percent_if_fraction(df: DataFrame, cols: list[str], limit: float = 1.5, quantile: float | None = None) -> DataFrame:
    """Scale a column to percent when its largest magnitude (or a quantile) says it is a fraction.

    One aggregate row holds the test of every column and is joined to all rows.
    """
    if not cols:
        return df
    if quantile is None:
        tests = df.agg(F.struct(*[(F.max(F.abs(c)) <= limit).alias(f"t{i}") for i, c in enumerate(cols)]).alias("t")).scalar()
    else:
        size = lambda c: quantiles(df, [], F.col(c), {"q": quantile}).select("q").scalar()
        tests = F.struct(*[(size(c) <= limit).alias(f"t{i}") for i, c in enumerate(cols)])
    d = df.withColumn("_t", tests)
    return d.withColumns({c: F.when(F.col(f"_t.t{i}"), F.col(c) * 100.0).otherwise(F.col(c)) for i, c in enumerate(cols)}).drop("_t")


def lower_names(df: DataFrame) -> DataFrame:
    """KPI tables in one spelling: our own in mixed case, published ones in lower case. Of columns
    that differ in case only the first stays."""
    first: dict[str, str] = {}
    for c in df.columns:
        first.setdefault(c.lower(), c)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in first.items()])


def metric_long(df: DataFrame, columns: dict[str, str], value: str) -> DataFrame:
    """Long form (country, plant_type[, period_key], metric, value)."""
    ids = [c for c in ("country", "plant_type", "period_key") if c in df.columns]
    wide = df.select(*[F.upper(F.trim(c)).alias(c) if c == "country" else F.col(c) for c in ids], *[num(c).alias(m) for m, c in columns.items()])
    return wide.unpivot(ids, list(columns), "metric", value)


def annual_corridor(dataset: DataFrame, report: DataFrame, source: str) -> DataFrame:
    """Spread of annual values against one published value per (country, type, metric)."""
    keys = ["country", "plant_type", "metric"]
    ref = report.groupBy(*keys).agg(F.min("report_value").alias("report_value"))
    v = F.col("dataset_value")
    g = dataset.groupBy(*keys).agg(F.count_distinct("period_key").alias("n_years"), F.min(v).alias("annual_min"), F.max(v).alias("annual_max"), F.count(v).alias("_n"))
    g = with_quantiles(g.filter("_n > 0").drop("_n"), dataset, keys, v, {"annual_q25": 0.25, "annual_median": 0.5, "annual_q75": 0.75})
    order = ["n_years", "annual_min", "annual_q25", "annual_median", "annual_q75", "annual_max"]
    d = g.select(*keys, *order).join(ref, keys)
    r = F.col("report_value")
    inside = (r >= F.col("annual_min")) & (r <= F.col("annual_max"))
    return d.withColumn("source", F.lit(source)).withColumn("in_corridor", inside).withColumn(
        "diff_to_corridor", F.when(r < F.col("annual_min"), r - F.col("annual_min")).when(r > F.col("annual_max"), r - F.col("annual_max")).otherwise(0.0)
    ).withColumn("corridor_status", F.when(inside, "inside corridor").when(~inside, "outside corridor"))


def eraa_reference(raw: DataFrame, technologies: dict[str, list[str]]) -> DataFrame:
    """Published outage rates per plant type; one technology may stand for several types."""
    m = F.create_map(*[x for t, ps in technologies.items() for x in (F.lit(t), F.array(*[F.lit(p) for p in ps]))])
    w = num("sum_of_capacity_with_forced_outage_mw")
    d = raw.withColumn("plant_type", F.explode(m[F.col("technology")])).withColumn("_w", w)
    return d.groupBy(F.upper(F.trim("country")).alias("country"), "ty", "plant_type").agg(
        weighted_mean("average_forced_outage_rate", "_w").alias("average_forced_outage_rate"),
        weighted_mean("weighted_average_forced_outage_rate", "_w").alias("weighted_average_forced_outage_rate"))


def tyndp_reference(raw: DataFrame, fuels: dict[str, str], year: int = 2030, scenario: str = "NationalTrends") -> DataFrame:
    """Published forced rates and planned days per plant type, weighted by capacity and by units."""
    m = F.create_map(*[F.lit(x) for kv in fuels.items() for x in kv])
    d = raw.filter((F.col("year") == year) & (F.col("scenario") == scenario)).withColumn("plant_type", m[F.col("fuel_type")]).filter("plant_type IS NOT NULL")
    g = d.groupBy(F.upper(F.trim("country")).alias("country"), "plant_type").agg(
        F.coalesce(F.sum("net_capacity_mw"), F.lit(0.0)).alias("net_capacity_mw_tot"), F.coalesce(F.sum("number_of_units"), F.lit(0.0)).alias("number_of_units_tot"),
        weighted_mean("forced_outage_rate_pct", "net_capacity_mw").alias("wFOR_tyndp"), weighted_mean("forced_outage_rate_pct", "number_of_units").alias("FOR_tyndp"),
        F.coalesce(F.sum(F.col("planned_outage_number_of_days") * F.col("net_capacity_mw")), F.lit(0.0)).alias("planned_outage_mw_days_tot"))
    g = g.filter("number_of_units_tot > 0").withColumn("wPOD_tyndp", ratio("planned_outage_mw_days_tot", "net_capacity_mw_tot"))
    return g.withColumn("wPOF_tyndp", F.col("wPOD_tyndp") / 365.0 * 100.0)


RATE_METRICS = {"uFOR": "ufor", "wFOR": "wfor", "uUOR": "uuor", "wUOR": "wuor", "uEFOR": "uefor", "wEFOR": "wefor", "uEUOR": "ueuor", "wEUOR": "weuor"}


def kpi_corridors(annual: DataFrame, eraa: DataFrame, tyndp: DataFrame) -> dict[str, DataFrame]:
    """Corridors of annual rates against both publications, and of outage days against one."""
    annual = lower_names(annual)
    have = {m: c for m, c in RATE_METRICS.items() if c in annual.columns}
    own = metric_long(percent_if_fraction(annual_rows(annual), list(have.values())), have, "dataset_value")

    def ref(df: DataFrame, u: str, w: str) -> DataFrame:
        d = percent_if_fraction(df, [u, w])
        return metric_long(d, {m: (w if m[0] == "w" else u) for m in have}, "report_value")

    days = outage_days(annual_rows(annual)).withColumn("_t", F.col("SOD") + F.col("UOD")).withColumn("_et", F.col("ESOD") + F.col("EUOD"))
    planned = {"wPOD": "POD", "wSOD": "SOD", "wMOD": "MOD", "wEPOD": "EPOD", "wESOD": "ESOD", "wEMOD": "EMOD"}
    total = {"SOD+UOD": "_t", "MOD": "MOD", "ESOD+EUOD": "_et", "EMOD": "EMOD"}
    tot = tyndp.withColumn("_all", F.col("wPOD_tyndp") + F.col("wFOR_tyndp") / 100.0 * 365.0)
    return {
        "eraa_rates": annual_corridor(own, ref(eraa, "average_forced_outage_rate", "weighted_average_forced_outage_rate"), "ERAA"),
        "tyndp_rates": annual_corridor(own, ref(tyndp, "FOR_tyndp", "wFOR_tyndp"), "TYNDP"),
        "tyndp_planned_days": annual_corridor(metric_long(days, planned, "dataset_value"), metric_long(tyndp, {m: "wPOD_tyndp" for m in planned}, "report_value"), "TYNDP"),
        "tyndp_total_days": annual_corridor(metric_long(days, total, "dataset_value"), metric_long(tot, {m: "_all" for m in total}, "report_value"), "TYNDP"),
    }


# --- source against source --------------------------------------------------------------


def common_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables whose key occurs in the other one."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return a.join(kb, keys, "left_semi"), b.join(ka, keys, "left_semi")


def pairwise(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Mean per country and group of two sources side by side, with differences."""
    m = lambda s: F.avg(F.when(F.col("source") == s, F.col("value"))).alias(s)
    d = df.filter(F.col("source").isin(a, b)).groupBy("country", group).agg(m(a), m(b)).filter(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
    return d.withColumn("diff", F.col(f"`{b}`") - F.col(f"`{a}`")).withColumn("abs_diff", F.abs("diff"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Mean difference with limits of agreement (mean +/- 1.96 sample deviations)."""
    g = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd_diff"))
    g = with_quantiles(g, pairs, [], F.col("diff"), {"median_diff": 0.5})
    return g.select("n", "mean_diff", "median_diff", "sd_diff").withColumn("lower_limit", F.col("mean_diff") - 1.96 * F.col("sd_diff")).withColumn("upper_limit", F.col("mean_diff") + 1.96 * F.col("sd_diff"))


def top_deviations(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("abs_diff"), "country").limit(n)


def matrix(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Country x group means (columns fixed by ``values``)."""
    return df.groupBy("country").pivot(group, values).avg("value")


def group_medians(df: DataFrame, group: str) -> DataFrame:
    g = df.groupBy(group, "source").agg(F.avg("value").alias("mean_value"), F.count("value").alias("n"))
    return with_quantiles(g, df, [group, "source"], F.col("value"), {"median_value": 0.5}).select(group, "source", "median_value", "mean_value", "n")


def colour_limits(df: DataFrame) -> DataFrame:
    """2nd and 98th percentile of a value column."""
    return with_quantiles(df.agg(F.count("value").alias("_n")), df, [], F.col("value"), {"p2": 0.02, "p98": 0.98}).drop("_n")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Chart tables in long form: rows and their share within the first key."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(keys[0])))


def preferred_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Add ``rank``: position in the preferred list, others after it."""
    r = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column)).cast("int")
    return df.withColumn("rank", F.when(r > 0, r).otherwise(len(order) + 1))
