import random

from helpers import h
from pyspark.sql import functions as F
from wattlens.operators import inverse, kpis, runs, tallies as tl, validation as val
from wattlens.operators.segments import from_hours, to_hours

COLS = ("eic_code string, unit_name string, country string, area string, plant_type string, plant_type_code string, asset_type string, timestamp timestamp, "
        "installed_capacity double, avail_capacity double, state string, outage_type string, outage_reason string, outage_id string")


def hour(t, state="avail", kind=None, reason=None, avail=None, unit="U1", oid=None):
    av = {"avail": 100.0, "out": 0.0}.get(state, 60.0) if avail is None else avail
    return (unit, unit, "DE", "A", "Nuclear", "B14", "GENERATION", h(t), 100.0, av, state, kind, reason, oid)


def panel(spark, rows):
    return from_hours(spark.createDataFrame(rows, COLS))


def test_maintenance_goes_to_its_own_class(spark):
    t = tl.tally(panel(spark, [hour(0, "out", "Planned", "maintenance")])).collect()[0]
    assert (t["MOH"], t["SOH"], t["POH"], t["UOH"]) == (1, 1, 0, 0)
    t = tl.tally(panel(spark, [hour(0, "derate", "Forced", "other")])).collect()[0]
    assert (round(t["EFDH"], 9), round(t["EUDH"], 9), t["FOH"]) == (0.4, 0.4, 0)


def test_runs_break_at_period_edges(spark):
    # 2020-01-30 + 46..49 h crosses into February
    rows = [hour(i, "out" if 46 <= i < 50 else "avail", "Forced" if 46 <= i < 50 else None, "other") for i in range(80)]
    t = tl.tally(panel(spark, rows))
    n = lambda p: sum(r["N_FO"] for r in kpis.block_kpis(t, p).collect())
    assert (n("M"), n("Y"), n("overall")) == (2, 1, 1)


def test_hours_and_intervals_agree(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        s = r.choice(["avail", "avail", "out", "derate"])
        rows.append(hour(i, s, r.choice(["Planned", "Forced"]) if s != "avail" else None, r.choice(["maintenance", "other"]) if s != "avail" else None))
    p = panel(spark, rows)
    keep = [c for c in p.columns if c not in ("seg_start", "seg_end", "eic_code")]
    merged = runs.merge_runs(p, ["eic_code"], keep)
    assert merged.count() < p.count()
    for period in ("M", "W", "overall"):
        a, b = (kpis.block_kpis(tl.tally(x), period, internal=True).drop("unit_name").collect() for x in (p, merged))
        rnd = lambda rows_: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in rows_)
        assert rnd(a) == rnd(b)
        for x in a:
            assert abs(x["AH"] + x["OH"] - x["ACTH"]) < 1e-9


def test_counting_window_starts_at_last_hour_of_first_run(spark):
    rows = [hour(i, "out" if i in (3, 4, 5, 9) else "avail", "Forced", "other") for i in range(12)]
    w = tl.counting_windows(tl.tally(panel(spark, rows)), "outage-span").collect()[0]
    assert (w["keep_start"], w["keep_end"], w["period_hours"]) == (h(5), h(9), 5)
    none = tl.counting_windows(tl.tally(panel(spark, [hour(i) for i in range(5)])), "first-generation").collect()[0]
    assert none["status"] == "no_outage_rows" and none["keep_start"] is None


def test_service_and_shutdown_hours(spark):
    t = tl.tally(panel(spark, [hour(i, "out" if i == 2 else "avail", "Forced", "other") for i in range(10)]))
    pos = spark.createDataFrame([("U1", h(1)), ("U1", h(2))], "eic_code string, timestamp timestamp")
    s, rep = tl.service_hours(t, pos)
    assert rep.collect()[0]["service_hours"] == 1
    _, sh = tl.economic_shutdown(t, pos, 5)
    assert [(x["start"], x["duration_h"]) for x in sh.collect()] == [(h(3), 7)]
    k = kpis.block_kpis(s, "overall").collect()[0]
    assert (k["SH"], k["RSH"]) == (1.0, 8.0)


def test_fleet_sums_equal_block_sums(spark):
    rows = [hour(i, "out" if i % 7 == u else "avail", "Forced", "other", unit=f"U{u}") for u in range(3) for i in range(50)]
    b = kpis.block_kpis(tl.tally(panel(spark, rows)).withColumn("plant_type", F.lit("N")), "overall", internal=True)
    f = kpis.fleet_kpis(b, ["country"]).collect()[0]
    assert f["ACTH"] == 150 and f["n_units"] == 3 and abs(f["uAF"] - f["wAF"]) < 1e-12


def _violating(spark):
    p = panel(spark, [hour(i, "out", "Forced", "other", oid="M1") for i in range(6)])
    g = spark.createDataFrame([("U1", h(i), 90.0) for i in range(6)], "eic_code string, timestamp timestamp, actual_generation_mw double")
    v = val.violation_hours(val.restricted(val.compared_capacity(p)), g)
    return p, v


REP = "mrid string, version long, unit_eic string, status string, old_version string, outage_type string, reason string, start_out timestamp, end_out timestamp, start_derate timestamp, end_derate timestamp, created_doc timestamp, avail_capacity double, installed_capacity double"


def _cand(spark, end):
    return spark.createDataFrame([("M9", 1, "U1", "Active", "false", "Planned", "x", h(0), h(end), h(0), h(end), h(-9), 95.0, 100.0)], REP)


def test_full_cover_beats_synthetic_and_partial_does_not(spark):
    _, v = _violating(spark)
    s, _ = val.violation_segments(v)
    top = lambda e: inverse.score_candidates(s, _cand(spark, e)).filter("score_rank = 1").collect()[0]["candidate_mrid"]
    assert top(6) == "M9"
    assert top(0.5) == "<NO_OUTAGE>"


def test_corrections_clear_the_outage(spark):
    p, v = _violating(spark)
    s, tagged = val.violation_segments(v)
    rec = inverse.recommend(s, inverse.score_candidates(s, _cand(spark, 0.5)))
    assert rec.collect()[0]["recommended_action"] == "remove_or_ignore_current_outage"
    mask = inverse.correction_mask(tagged, rec)
    fixed = inverse.apply_corrections(p, mask)
    t = tl.tally(fixed).agg(F.sum(F.col("FOH") * runs.hours_col()).alias("f"), F.sum(F.col("avail_capacity") * runs.hours_col()).alias("a")).collect()[0]
    assert (t["f"], t["a"]) == (0, 600.0)
    r = inverse.correction_report(p, mask).collect()[0]
    assert (r["matched_panel_rows"], r["unmatched_correction_keys"]) == (6, 0)


def test_qa_sees_gaps_and_duplicates(spark):
    rows = [hour(0), hour(1), hour(1), hour(4)]
    q = tl.input_qa(panel(spark, rows)).collect()[0]
    assert (q["duplicate_timestamp_rows"], q["missing_hourly_timestamps"]) == (1, 2)
