"""Which raw report explains a violation? Scoring, recommendation, correction masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays, text
from ..functions.maths import clip, nz, ratio
from ..functions.times import floor_hour
from .generation import tolerance
from .overlap import match_hours, overlap_join
from .reports import DOC
from .rows import best_row
from .runs import END, START
from .segments import from_hours
from .timeline import cut_by, rejoined, runs_of_hours

CANCELLED = ["cancelled", "canceled", "withdrawn"]
DEFAULT_ACTIONS = ["remove_or_ignore_current_outage", "respect_later_cancellation_or_withdrawal", "unresolved_by_raw_candidates"]


def latest_mrid_rows(raw: DataFrame) -> DataFrame:
    """Rows of each document's highest active version, plus cancellations created after it."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    key = F.trim(F.coalesce("mrid", F.lit("")))
    d = raw.withColumn("_k", key).withColumn("_s", status).withColumn("_v", F.coalesce(F.col("version").cast("double"), F.lit(-1.0)))
    d = d.withColumn("_act", (F.col("_s") == "active") & ~text.is_true_like("old_version"))
    dealt = [c for c in (DOC,) if c in raw.columns]  # rows of a document are together already
    of = Window.partitionBy(*dealt, "_k")
    d = d.withColumn("_top", F.max(F.when(F.col("_act") & (F.col("_k") != ""), F.col("_v"))).over(of))
    j = d.withColumn("_last", F.max(F.when(F.col("_act") & (F.col("_v") == F.col("_top")), F.col("created_doc"))).over(of))
    keep = F.when(F.col("_act"), (F.col("_k") == "") | (F.col("_v") == F.col("_top"))).otherwise(
        F.col("_s").isin(*CANCELLED) & (F.col("created_doc") > F.col("_last")))
    return j.filter(F.coalesce(keep, F.lit(False))).select("_k", *raw.columns).distinct().drop("_k", *dealt)


def candidates_in_scope(raw: DataFrame, segments: DataFrame, window_hours: float = 0.0) -> DataFrame:
    """Raw reports of the segments' units touching their overall time span."""
    span = segments.groupBy("eic_code").agg(F.min("segment_start_utc").alias("_a"), F.max("segment_end_utc").alias("_b"))
    slack = F.expr(f"INTERVAL {int(window_hours * 3600)} SECOND")
    d = raw.withColumn("start_derate", F.coalesce("start_derate", "start_out")).withColumn("end_derate", F.coalesce("end_derate", "end_out"))
    j = d.join(span, F.trim(d["unit_eic"]) == span["eic_code"])
    return j.filter((F.col("start_derate") < F.col("_b") + slack) & (F.col("end_derate") > F.col("_a") - slack)).select(*d.columns)


def score_candidates(segments: DataFrame, raw: DataFrame, window_hours: float = 0.0, tol_mw: float = 0.0, tol_rel: float = 0.0,
                     max_per_segment: int | None = None) -> DataFrame:
    """Rank the raw reports near each segment, with the synthetic "no outage" candidate.

    Score: 1000 x unexplained MW + 10 x uncovered hours + status, version and no-outage
    penalties + relative change of availability; lowest wins. All candidates are ranked and
    kept; ``max_per_segment`` asks for the first so many only (see ``top_candidates``).
    """
    seg = segments.select("segment_id", "eic_code", "segment_start_utc", "segment_end_utc",
                          F.col("segment_duration_h").alias("dur"), nz("max_comparison_installed_capacity_mw").alias("seg_inst"),
                          F.col("min_comparison_available_capacity_mw").alias("seg_av"), nz("max_actual_generation_mw").alias("gen"))
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    has = lambda c, t: F.col(c) if c in raw.columns else F.lit(None).cast(t)
    r = raw.select(
        F.trim("unit_eic").alias("eic_code"), F.coalesce("start_derate", "start_out").alias("c_start"),
        F.coalesce("end_derate", "end_out").alias("c_end"), F.col("mrid").alias("candidate_mrid"),
        has("original_mrid", "string").alias("candidate_original_mrid"), has("mrid_unit_scope", "string").alias("candidate_mrid_unit_scope"),
        status.alias("candidate_status_norm"), text.is_true_like("old_version").alias("candidate_old_version"),
        F.col("version").alias("candidate_version"), F.col("outage_type").alias("candidate_outage_type"),
        F.col("reason").alias("candidate_reason"), F.col("created_doc").alias("candidate_created_doc_utc"),
        F.col("installed_capacity").alias("c_inst"), F.col("avail_capacity").alias("c_av"))
    # reports outside the span of all segments, or of their unit's, meet none
    slack = F.expr(f"INTERVAL {math.ceil(window_hours * 3600) + 1} SECOND")
    first, last = (F.min("segment_start_utc") - slack).alias("_a"), (F.max("segment_end_utc") + slack).alias("_b")
    span = seg.agg(F.struct(first, last)).scalar()
    r = r.filter((F.col("c_start") < span["_b"]) & (F.col("c_end") > span["_a"]))
    r = r.join(seg.groupBy("eic_code").agg(first, last), "eic_code").filter((F.col("c_start") < F.col("_b")) & (F.col("c_end") > F.col("_a"))).drop("_a", "_b")
    p = overlap_join(seg, r, ["eic_code"], ("segment_start_utc", "segment_end_utc"), ("c_start", "c_end"), window_hours)
    gone = F.col("candidate_status_norm").isin(*CANCELLED)
    inst = F.when(F.col("seg_inst") > 0, F.col("seg_inst")).otherwise(nz("c_inst"))
    p = p.withColumn("inst", inst)
    av = (
        F.when(gone | F.col("c_av").isNull(), F.col("inst"))
        .when(F.col("c_inst") > 0, clip(F.col("c_av") / F.col("c_inst"), 0.0, 1.0) * F.col("inst"))
        .otherwise(F.least(F.greatest(F.col("c_av"), F.lit(0.0)), F.col("inst")))
    )
    sec = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9
    over = F.greatest(sec(F.greatest("c_start", "segment_start_utc"), F.least("c_end", "segment_end_utc")), F.lit(0.0))
    p = p.withColumn("av", av).withColumn("overlap_h", over)
    p = p.withColumn("gap_h", F.when(F.col("overlap_h") > 0, 0.0).when(
        F.col("c_end") <= F.col("segment_start_utc"), sec(F.col("c_end"), F.col("segment_start_utc"))).otherwise(
        sec(F.col("segment_end_utc"), F.col("c_start"))))
    p = p.withColumn("status_penalty", F.when(F.col("candidate_status_norm") == "active", 0.0).when(gone, 5.0).otherwise(25.0))
    p = p.withColumn("candidate_kind", F.when(gone, "cancelled_or_withdrawn").otherwise("raw_report")).withColumn(
        "no_outage_penalty", F.lit(0.0)).withColumn("last", F.lit(False))
    blank = {c: F.lit(None).cast(p.schema[c].dataType) for c in p.columns if c not in seg.columns}
    synth = seg.withColumns(blank).withColumns({
        "c_start": F.col("segment_start_utc"), "c_end": F.col("segment_end_utc"), "candidate_mrid": F.lit("<NO_OUTAGE>"),
        "candidate_original_mrid": F.lit("<NO_OUTAGE>"), "candidate_status_norm": F.lit("no_outage"),
        "candidate_old_version": F.lit(False), "candidate_outage_type": F.lit("no_outage"),
        "candidate_reason": F.lit("no_raw_report_needed"), "inst": F.col("seg_inst"), "av": F.col("seg_inst"),
        "c_inst": F.col("seg_inst"), "c_av": F.col("seg_inst"), "overlap_h": F.col("dur"), "gap_h": F.lit(0.0),
        "status_penalty": F.lit(25.0), "no_outage_penalty": F.lit(25.0), "candidate_kind": F.lit("no_outage"), "last": F.lit(True)})
    d = p.unionByName(synth.select(*p.columns))
    gen = F.when(F.col("inst") > 0, F.least("gen", "inst")).otherwise(F.col("gen"))
    d = d.withColumn("candidate_generation_capped_mw", gen)
    d = d.withColumn("candidate_residual_excess_mw", F.greatest(
        F.col("candidate_generation_capped_mw") - F.col("av") - tolerance(F.col("inst"), tol_mw, tol_rel), F.lit(0.0)))
    d = d.withColumn("candidate_uncovered_segment_hours", F.greatest(F.col("dur") - F.col("overlap_h"), F.lit(0.0)))
    d = d.withColumn("coverage_penalty", F.col("candidate_uncovered_segment_hours") * 10.0)
    d = d.withColumn("old_version_penalty", F.when(F.col("candidate_old_version"), 20.0).otherwise(0.0))
    d = d.withColumn("availability_change_penalty",
                     F.abs(F.col("av") - F.coalesce("seg_av", "seg_inst")) / F.greatest(F.col("inst"), F.lit(1.0)))
    d = d.withColumn("candidate_score", F.col("candidate_residual_excess_mw") * 1000.0 + F.col("coverage_penalty") + F.col("status_penalty")
                     + F.col("old_version_penalty") + F.col("no_outage_penalty") + F.col("availability_change_penalty"))
    w = Window.partitionBy("segment_id").orderBy(
        "candidate_score", "candidate_residual_excess_mw", "candidate_uncovered_segment_hours", "last",
        F.col("c_start").asc_nulls_last(), F.col("candidate_version").asc_nulls_last(),
        F.col("candidate_created_doc_utc").asc_nulls_last(), "candidate_mrid", "c_end", "c_av")
    d = d.withColumn("score_rank", F.row_number().over(w))
    if max_per_segment is not None:
        d = top_candidates(d, max_per_segment)
    return d.withColumn("candidate_resolves_violation", F.col("candidate_residual_excess_mw") <= 1e-9).select(
        "segment_id", "score_rank", "candidate_kind", "candidate_mrid", "candidate_original_mrid", "candidate_mrid_unit_scope",
        "candidate_status_norm", "candidate_old_version", "candidate_version", "candidate_outage_type", "candidate_reason",
        F.col("c_start").alias("candidate_start_derate_utc"), F.col("c_end").alias("candidate_end_derate_utc"), "candidate_created_doc_utc",
        F.col("c_inst").alias("candidate_report_installed_capacity_mw"), F.col("c_av").alias("candidate_report_available_capacity_mw"),
        F.col("inst").alias("candidate_effective_installed_capacity_mw"), F.col("av").alias("candidate_effective_available_capacity_mw"),
        "candidate_generation_capped_mw", "candidate_residual_excess_mw", "candidate_resolves_violation",
        F.col("overlap_h").alias("candidate_overlap_hours"), "candidate_uncovered_segment_hours",
        F.col("gap_h").alias("candidate_gap_to_segment_hours"), "status_penalty", "coverage_penalty", "old_version_penalty",
        "no_outage_penalty", "availability_change_penalty", "candidate_score")


def top_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best-ranked candidates of every segment."""
    return candidates.filter(F.col("score_rank") <= k)


def recommend(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate per segment and the action it implies."""
    best = candidates.filter("score_rank = 1")
    d = segments.join(best, "segment_id", "left")
    scope = F.upper(F.trim(F.coalesce("candidate_mrid_unit_scope", F.lit(""))))
    same = arrays.id_listed("current_outage_ids", F.coalesce("candidate_mrid", F.lit(""))) | (
        arrays.id_listed("current_outage_ids", F.coalesce("candidate_original_mrid", F.lit("")))
        & (scope != "") & (scope == text.eic_norm("eic_code")))
    ok = F.coalesce("candidate_resolves_violation", F.lit(False))
    d = d.withColumn("candidate_same_as_current_report", F.coalesce(same, F.lit(False)))
    return d.withColumn("recommended_action", F.when(
        ok & F.col("candidate_same_as_current_report"), "keep_current_report_capacity_issue")
        .when(ok & (F.col("candidate_kind") == "no_outage"), "remove_or_ignore_current_outage")
        .when(ok & (F.col("candidate_kind") == "cancelled_or_withdrawn"), "respect_later_cancellation_or_withdrawal")
        .when(ok, "replace_with_candidate_raw_report").otherwise("unresolved_by_raw_candidates"))


def correction_mask(tagged_hours: DataFrame, recommendations: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """Unit-hours to be set to full availability, with the reason."""
    rec = recommendations.filter(F.col("recommended_action").isin(*(actions or DEFAULT_ACTIONS))).select(
        "segment_id", "recommended_action", "candidate_kind", "candidate_mrid", "candidate_residual_excess_mw", "candidate_resolves_violation")
    h = tagged_hours.join(rec, "segment_id")
    keep = [c for c in ("country", "asset_type", "area", "plant_type", "plant_type_code", "eic_code", "unit_name") if c in h.columns]
    return h.select(
        floor_hour("timestamp").alias("timestamp"), *keep, F.col("segment_id").alias("inverse_segment_id"),
        F.col("recommended_action").alias("inverse_recommended_action"), F.col("candidate_kind").alias("inverse_candidate_kind"),
        F.col("candidate_mrid").alias("inverse_candidate_mrid"), F.lit(True).alias("inverse_correction_flag"),
        (F.col("recommended_action") == "unresolved_by_raw_candidates").alias("inverse_unreconstructable_flag"),
        F.lit(True).alias("set_availability_to_installed_capacity"), F.col("cmp_installed").alias("corrected_available_capacity_mw"),
        F.lit(1.0).alias("corrected_availability_factor"), "actual_generation_mw", "excess_generation_above_tolerance_mw"
    ).filter(F.col("timestamp").isNotNull())


def mask_index(mask: DataFrame) -> DataFrame:
    return mask.groupBy("country", "asset_type", "plant_type_code").agg(
        F.count(F.lit(1)).alias("correction_rows"), F.count_distinct("eic_code").alias("units"),
        F.count_distinct("inverse_segment_id").alias("segments"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"))


LABELS = ["outage_id", "outage_type", "outage_reason", "dominant_outage_id", "dominant_outage_type", "dominant_outage_reason",
          "dominant_reason_inferred", "type_observed", "type_effective", "type_warning"]
LOSSES = ["scheduled_loss_mw", "forced_increment_mw", "total_derate_mw", "derate_mw_planned_other",
          "derate_mw_planned_maintenance", "derate_mw_forced_other", "derate_mw_forced_maintenance"]


def eligible(mask: DataFrame) -> DataFrame:
    for c in ("inverse_correction_flag", "set_availability_to_installed_capacity"):
        if c in mask.columns:
            mask = mask.filter(text.flag_with_default(c, False))
    return mask


def _mask_keys(panel: DataFrame, mask: DataFrame) -> list[str]:
    """The key columns besides the hour: those both sides have."""
    return ["eic_code"] + [c for c in ("country", "plant_type_code", "asset_type", "area") if c in panel.columns and c in mask.columns]


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def mask_runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """A mask's hours as disjoint runs with equal corrections. Of mask rows with one key and
    hour the one with the largest ``mask_order`` counts, else that of the last segment."""
    tags = [c for c in ("inverse_segment_id", "inverse_recommended_action") if c in mask.columns]
    order = [c for c in ("mask_order",) if c in mask.columns]
    m = eligible(mask).select(*[_clean(k).alias(k) for k in keys], floor_hour("timestamp").alias("timestamp"),
                              F.col("corrected_available_capacity_mw").alias("_corr"), *[F.col(c).alias(f"_i_{c}") for c in tags], *[F.col(c).alias("_order") for c in order])
    last = [F.col(c) for c in ("_order", "_i_inverse_segment_id") if c in m.columns]
    m = best_row(m, [*keys, "timestamp"], last).drop("_order").filter(F.col("timestamp").isNotNull())
    return runs_of_hours(m, keys, ["_corr", *[f"_i_{c}" for c in tags]])


def apply_corrections(panel: DataFrame, mask: DataFrame) -> DataFrame:
    """Overwrite the masked time of a panel: available = corrected value (else installed), state
    avail, labels cleared, losses 0.

    Interval difference, no hours: the mask becomes runs, each interval is split where a run
    begins or ends, covered pieces are replaced, and touching pieces that became equal are
    joined again. Rows with a ``timestamp`` and no bounds are taken as intervals of one hour.
    """
    panel = panel if START in panel.columns else from_hours(panel)
    keys = _mask_keys(panel, mask)
    runs = mask_runs(mask, keys)
    values = [c for c in runs.columns if c.startswith("_")]
    d = cut_by(panel, runs, {k: _clean(k) for k in keys}, values, "_hit")
    hit = F.col("_hit").isNotNull()
    new = F.coalesce("_hit._corr", "installed_capacity")
    cols = {"state": F.when(hit, "avail").otherwise(F.col("state"))}
    cols |= {c: F.when(~hit, F.col(c)) for c in LABELS if c in panel.columns}
    cols |= {c: F.when(hit, 0.0).otherwise(F.col(c)) for c in LOSSES if c in panel.columns}
    if "relative_avail_capacity" in panel.columns:
        cols["relative_avail_capacity"] = F.when(hit, ratio(new, F.col("installed_capacity"))).otherwise(F.col("relative_avail_capacity"))
    cols["avail_capacity"] = F.when(hit, new).otherwise(F.col("avail_capacity"))
    cols["inverse_correction_applied"] = hit
    cols |= {c[3:]: F.col(f"_hit.{c}") for c in values if c.startswith("_i_")}
    d = d.withColumns(cols).drop("_hit")
    return d.filter(~F.col("inverse_correction_applied")).unionByName(rejoined(d.filter("inverse_correction_applied"), keys))


def correction_report(panel: DataFrame, mask: DataFrame) -> DataFrame:
    """One row: eligible, duplicate, matched and unmatched correction keys; panel rows are hours."""
    keys = _mask_keys(panel, mask)
    e = eligible(mask).groupBy("timestamp", *keys).agg(F.count(F.lit(1)).alias("n"))
    look = e.filter(F.col("timestamp") == floor_hour("timestamp")).select("timestamp", F.col("eic_code"), *[F.col(k).alias(f"_e_{k}") for k in keys[1:]])
    met = match_hours(look, panel.select(*keys, START, END))
    for k in keys[1:]:
        met = met.filter(F.col(k) == F.col(f"_e_{k}"))
    found = met.groupBy("timestamp", *keys).agg(F.count(F.lit(1)).alias("rows"))
    j = e.join(found, ["timestamp", *keys], "left")
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("eligible_correction_rows"), F.count(F.lit(1)).alias("unique_correction_keys"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_correction_keys"),
                 F.coalesce(F.sum("rows"), F.lit(0)).alias("matched_panel_rows"),
                 F.coalesce(F.sum(F.col("rows").isNull().cast("long")), F.lit(0)).alias("unmatched_correction_keys"))


def resolution_category() -> Column:
    """Group of a recommended action."""
    a = F.col("recommended_action")
    return (
        F.when(a == "keep_current_report_capacity_issue", "capacity_issue").when(a == "replace_with_candidate_raw_report", "raw_report_replaces")
        .when(a == "respect_later_cancellation_or_withdrawal", "cancelled_or_withdrawn")
        .when(a == "remove_or_ignore_current_outage", "no_outage_needed").otherwise("unresolved")
    )


def action_breakdown(recs: DataFrame, keys: list[str]) -> DataFrame:
    """Segments, hours and energy per group with counts of each action and candidate kind."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    actions = ["keep_current_report_capacity_issue", "remove_or_ignore_current_outage", "respect_later_cancellation_or_withdrawal",
               "replace_with_candidate_raw_report", "unresolved_by_raw_candidates"]
    return recs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("violation_hours").alias("violation_hours"),
        F.sum("sum_excess_generation_above_tolerance_mwh").alias("excess_generation_mwh"),
        *[n("recommended_action", a).alias(f"n_{a}") for a in actions],
        *[n("candidate_kind", k).alias(f"candidates_{k}") for k in ("raw_report", "cancelled_or_withdrawn", "no_outage")])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share per category."""
    g = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    # the window sees one row per category
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
