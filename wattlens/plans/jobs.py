"""User-level jobs: compositions of the operators, all lazy but for shared intermediates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import (capacity as cap, compare, diagnose as dg, generation as gen, inverse, kpis, references, registers, tallies as tl,
                         validation as val)
from ..operators.panel import PanelOptions, build_panel, build_segments, outage_sums
from ..operators.reports import Prepared, prepare_reports, scope_mrids
from ..operators.segments import from_hours, to_hours
from ..session import materialise, settled

__all__ = ["Prepared", "prepare_reports", "panel_job", "statistics", "StatisticsOptions", "availability_vs_generation", "inverse_availability",
           "diagnose", "compare_panels", "kpi_corridors", "integrate_registers", "describe_register", "site_aggregates", "compare_sources", "build_panel"]

compare_panels = compare.compare_panels
kpi_corridors = compare.kpi_corridors
integrate_registers = registers.integrate_registers
describe_register = registers.describe_register
site_aggregates = registers.site_aggregates


def panel_job(clean: DataFrame, start: str, end: str, opts: PanelOptions = PanelOptions()) -> dict[str, DataFrame]:
    """Interval panel, hourly panel and area sums from cleaned reports."""
    segs = settled(lambda: build_segments(clean, start, end, opts))
    return {"segments": segs, "panel": to_hours(segs), "outage_sums": outage_sums(segs)}


@dataclass(frozen=True)
class StatisticsOptions:
    counting_window: str = "full"
    min_generation_share: float = 0.0
    max_low_generation_hours: float | None = None
    min_generation_frequency: float | None = None
    min_outage_clusters: int | None = None
    economic_shutdown_hours: int | None = None
    generation_service_hours: bool = False
    long_outage_hours: int = 365 * 24
    drop_long_outages: bool = False
    group: list[str] = field(default_factory=lambda: ["country", "plant_type"])
    periods: tuple[str, ...] = ("M", "MOY", "Y", "overall")


def statistics(panel: DataFrame, opts: StatisticsOptions = StatisticsOptions(), generation: DataFrame | None = None,
               corrections: DataFrame | None = None, dimension: DataFrame | None = None) -> dict[str, DataFrame]:
    """Panel (intervals) to unit and fleet KPIs.

    Order: one block per unit, low-generation units out, corrections, tallies, counting
    window, generation frequency, few clusters, economic shutdown or service hours,
    plant attributes, long outages, KPIs.
    """
    if opts.economic_shutdown_hours and opts.generation_service_hours:
        raise ValueError("economic shutdown and generation service hours exclude each other")
    out: dict[str, DataFrame] = {}
    panel, out["duplicate_blocks"] = tl.dedup_units(panel)
    pos = bounds = None
    if generation is not None:
        pos = gen.positive_hours(generation, gen.unit_capacity(panel), opts.min_generation_share)
        bounds = gen.generation_bounds(pos)
        if opts.max_low_generation_hours is not None:
            panel, out["low_generation_units"] = tl.exclude_low_generation(panel, bounds, opts.max_low_generation_hours)
    out["input_qa"] = tl.input_qa(panel)
    out["input_qa_summary"] = tl.input_qa_summary(out["input_qa"])
    if corrections is not None:
        out["correction_report"] = inverse.correction_report(panel, corrections)
        panel = inverse.apply_corrections(panel, corrections)
    t = tl.tally(panel)
    if opts.counting_window != "full":
        windows = tl.counting_windows(t, opts.counting_window, bounds)
        out["counting_windows"] = tl.window_report(t, windows)
        t = tl.apply_windows(t, windows)
        if opts.min_generation_frequency is not None and pos is not None:
            t, _, out["rare_generation_units"] = tl.exclude_rare_generation(t, windows, gen.counts_in_windows(pos, windows), opts.min_generation_frequency)
    if opts.min_outage_clusters is not None:
        t, out["few_cluster_units"] = tl.exclude_few_clusters(t, opts.min_outage_clusters)
    if pos is not None and opts.economic_shutdown_hours:
        t, out["economic_shutdown"] = tl.economic_shutdown(t, gen.hours_in_windows(pos, tl.unit_windows(t)), opts.economic_shutdown_hours)
    elif pos is not None and opts.generation_service_hours:
        t, out["service_hours"] = tl.service_hours(t, gen.hours_in_windows(pos, tl.unit_windows(t)))
    if dimension is not None:
        t = kpis.enrich(t, dimension)
    t = materialise(t)
    t, out["long_outages"] = tl.long_outages(t, opts.long_outage_hours, opts.drop_long_outages)
    out["cluster_report"] = tl.cluster_report(t)
    unit_keys = list(dict.fromkeys([*kpis.BLOCK_KEYS, *opts.group]))
    for p in opts.periods:
        b = kpis.block_kpis(t, p, internal=True, keys=unit_keys)
        out[f"blocks_{p}"] = b.drop(*[c for c in b.columns if c.startswith("_w")], *kpis.MOMENTS)
        out[f"fleet_{p}"] = kpis.fleet_kpis(b, opts.group)
    return out


def availability_vs_generation(panel: DataFrame, generation: DataFrame, lookup: DataFrame | None = None, plant_map: DataFrame | None = None,
                               only_restricted: bool = False, max_cluster_days: float | None = None, tol_mw: float = 0.0, tol_rel: float = 0.0,
                               min_share: float = 0.0, zero_below: float = 0.0) -> dict[str, DataFrame]:
    """Factors, violations and summaries at unit level, or at plant level with a plant map.

    ``min_share``: generation below this share of capacity counts as none; ``zero_below``:
    availability at or below this share counts as none.
    """
    p = val.compared_capacity(panel, lookup, zero_below)
    out: dict[str, DataFrame] = {}
    if only_restricted or max_cluster_days:
        p = val.restricted(p)
        p, out["excluded_clusters"] = val.drop_long_clusters(p, max_cluster_days)
    if plant_map is not None:
        ids = registers.attach_plants(p.select("eic_code", "unit_name", "country", "plant_type", "asset_type").distinct(), plant_map)
        members = registers.plant_generation_units(ids, plant_map)
        generation = gen.to_plants(generation, members.select("eic_code", "plant_id"))
        p = registers.to_plant_panel(from_hours(to_hours(p)), ids)
        for c in ("asset_type", "area", "plant_type_code"):
            if c not in p.columns:
                p = p.selectExpr("*", f"cast(NULL as string) AS {c}")
    p = materialise(p)
    compared = materialise(val.compare_hours(p, generation, tol_mw, tol_rel, min_share))
    uy = val.unit_year_summary(p, compared)
    violations = compared.filter("is_violation")
    out["hourly"] = val.availability_vs_generation(p, generation, tol_mw, tol_rel, min_share, compared)
    out["daily"] = val.daily(out["hourly"])
    out["summary"] = val.daily_summary(out["daily"])
    out["full_hourly"], out["generation_only_units"] = val.full_unit_series(p, generation, lookup, min_share=min_share)
    out |= {"violation_hours": violations, "unit_year": uy, "country_type_year": val.roll_up(uy, ["country", "plant_type", "year"]),
            "country_type": val.roll_up(uy, ["country", "plant_type"]), "monthly": val.monthly_violations(violations)}
    return out


def inverse_availability(panel: DataFrame, generation: DataFrame, raw: DataFrame, lookup: DataFrame | None = None, window_hours: float = 0.0,
                         tol_mw: float = 0.0, tol_rel: float = 0.0, max_candidates: int | None = None, actions: list[str] | None = None,
                         min_share: float = 0.1, zero_below: float = 0.0, countries: list[str] | None = None,
                         plant_types: list[str] | None = None) -> dict[str, DataFrame]:
    """Violations -> ranked reports -> recommended actions -> correction masks.

    ``min_share`` and ``zero_below`` as in ``availability_vs_generation``; by default generation
    below a tenth of capacity counts as none. ``countries`` and ``plant_types`` (codes) are the
    scope: only units of theirs are looked at, and only reports of such units are candidates.
    """
    if countries:
        panel = panel.filter(panel["country"].isin(*countries))
    if plant_types:
        panel = panel.filter(panel["plant_type_code"].isin(*plant_types))
    p = val.restricted(val.compared_capacity(panel, lookup, zero_below))
    hours = materialise(val.violation_hours(p, generation, tol_mw, tol_rel, min_share))
    segments, tagged = val.violation_segments(hours)
    segments = materialise(segments)
    raw = raw if "mrid_unit_scope" in raw.columns else scope_mrids(raw)  # a document on two units is two documents
    scope = inverse.candidates_in_scope(inverse.latest_mrid_rows(raw), segments, window_hours)
    if lookup is not None:
        scope = cap.attach_capacity(scope, lookup, "start_derate", out="installed_capacity_ext").drop("installed_capacity").withColumnRenamed(
            "installed_capacity_ext", "installed_capacity")
    cands = materialise(inverse.score_candidates(segments, scope, window_hours, tol_mw, tol_rel, max_candidates))
    recs = materialise(inverse.recommend(segments, cands).withColumn("resolution_category", inverse.resolution_category()))
    mask = inverse.correction_mask(tagged, recs, actions)
    return {"violation_hours": hours, "segments": segments, "candidates": cands, "recommendations": recs, "masks": mask,
            "unit_summary": inverse.action_breakdown(recs, ["country", "plant_type", "eic_code"]),
            "country_summary": inverse.action_breakdown(recs, ["country"]), "type_summary": inverse.action_breakdown(recs, ["plant_type"]),
            "actions": inverse.distribution(recs, "recommended_action"), "kinds": inverse.distribution(recs, "candidate_kind"),
            "resolution": inverse.distribution(recs, "resolution_category")}


def diagnose(panel: DataFrame, generation: DataFrame, reports: DataFrame | None = None, lookup: DataFrame | None = None,
             tol_mw: float = 0.0, tol_rel: float = 0.0, min_share: float = 0.0) -> dict[str, DataFrame]:
    """Violations by position, severity and component; gaps inside outages; unit overview."""
    full = val.compared_capacity(tl.dedup_unit_hours(panel), lookup)
    segs = materialise(dg.add_segments(val.restricted(full)))
    compared = materialise(val.compare_hours(segs, generation, tol_mw, tol_rel, min_share))
    rows = dg.violation_rows(compared)
    if reports is not None:
        rows = dg.attach_events(rows, dg.event_metadata(reports), "segment_outage_id", "segment_start")
    rows = materialise(rows)
    out = {"violation_rows": rows, "segments": dg.segment_summary(rows), "availability_segments": dg.availability_segments(segs),
           "units": dg.unit_summary(segs, compared, rows)}
    out |= {f"by_{n}": d for n, d in dg.summarize_many(rows, dg.GROUPINGS).items()}
    gaps = materialise(dg.gap_generation(dg.gap_intervals(full), generation, min_share))
    out |= {"gap_rows": gaps, "gap_segments": dg.gap_segments(gaps)}
    out |= {f"gaps_by_{n}": dg.summarize_gaps(gaps, k) for n, k in dg.GAP_GROUPINGS.items()}
    return out


def compare_sources(table: DataFrame, group: str, a: str, b: str, top: int) -> dict[str, DataFrame]:
    """Chart-ready tables of two labelled sources (columns country, group, source, value)."""
    one, two = compare.common_pairs(table.filter(table["source"] == a), table.filter(table["source"] == b), ["country", group])
    both = one.unionByName(two)
    pairs = compare.pairwise(both, group, a, b)
    return {"pairs": pairs, "agreement": compare.agreement(pairs), "top": compare.top_deviations(pairs, top),
            "group_medians": compare.group_medians(both, group), "colour_limits": compare.colour_limits(both)}


def compare_metrics(table: DataFrame, group: str, reference: str, own: str, top: int, metrics: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of our own KPIs against a published source, metric by metric, from one wide table
    (country, group, source, KPI columns). ``metrics``: by default those of the source."""
    rows = materialise(references.metric_rows(table, group, reference, own, metrics))
    out = {"values": rows}
    for m in metrics or references.default_metrics(reference):
        out |= {f"{k}_{m}": v for k, v in compare_sources(rows.filter(rows["metric"] == m).drop("metric"), group, reference, own, top).items()}
    return out
