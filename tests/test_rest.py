import os

import pytest

from helpers import T0, frame, h, random_reports
from pyspark.sql import functions as F
from wattlens.functions import arrays, binning, text, times
from wattlens.operators import compare, overlap, registers as rg
from wattlens.plans import jobs
from wattlens.sources import readers, writers


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items()))
    return df.select(col.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("name,stem", [("Power Station Block 2", "power station"), ("Unit 3", "unit 3"), ("St A", "st a"), ("Plant B", "plant"), ("Moor IV", "moor")])
def test_name_stem(spark, name, stem):
    assert one(spark, rg.name_stem("v"), v=name) == stem


def test_three_flag_readings(spark):
    assert one(spark, text.is_false_like("v"), v=None) is True
    assert one(spark, text.is_true_like("v"), v=None) is False
    assert one(spark, text.flag_with_default("v", True), v="maybe") is True


def test_canonical_plant_type_and_codes(spark):
    from wattlens.functions import codes

    assert one(spark, codes.plant_type_code("v"), v=" Hydro Run-of-river and pondage ") == "B11"
    assert one(spark, codes.country_of_label("v"), v="GB_NIR") == "NI"
    assert one(spark, codes.country_of_label("v"), v="DE_50HZ") == "DE"


def test_bins_closed_sides(spark):
    b = lambda v: one(spark, binning.bins("v", [0, 1, 6], ["a", "b"]), v=v)
    assert [b(0.0), b(1.0), b(1.5), b(7.0)] == ["a", "a", "b", None]


def test_iso_week_key(spark):
    assert one(spark, times.period_key(F.lit("2021-01-03").cast("timestamp"), "W"), v="") == "2020-W53"


def test_id_lists_keep_order(spark):
    assert one(spark, arrays.join_ids(F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit(None))), v="") == "b|a"


def test_overlap_join_counts_each_pair_once(spark):
    a = spark.createDataFrame([("U", h(0), h(24 * 90))], "k string, a0 timestamp, a1 timestamp")
    b = spark.createDataFrame([("U", h(10), h(24 * 80)), ("U", h(24 * 95), h(24 * 96))], "k string, b0 timestamp, b1 timestamp")
    assert overlap.overlap_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1")).count() == 1
    assert overlap.overlap_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 24 * 6).count() == 2


def test_percent_if_fraction(spark):
    d = spark.createDataFrame([(0.1, 20.0), (0.5, 40.0)], "a double, b double")
    assert sorted(tuple(r) for r in compare.percent_if_fraction(d, ["a", "b"]).collect()) == [(10.0, 20.0), (50.0, 40.0)]


def test_report_reader_mends_bad_lines(spark, tmp_path):
    p = tmp_path / "GenerationUnits" / "r.csv"
    os.makedirs(p.parent)
    p.write_text("MRID\tUnitName\tAssetCode\tStartOutage\tEndOutage\tAvailableCapacity\tReason\n"
                 "M1\tAlpha\tU1\t2020-01-30 00:00\t2020-01-31T00:00:00Z\t10\tok\n"
                 "M2\tBeta\tU2\t2020-01-30 00:00:00.000\tjunk\tx\tok\n")
    r = {x["mrid"]: x for x in readers.read_reports(spark, str(p)).collect()}
    assert r["M1"]["start_out"] == T0 and r["M1"]["end_out"] == h(24) and r["M1"]["asset_type"] == "GENERATION"
    assert r["M2"]["end_out"] is None and r["M2"]["avail_capacity"] is None and r["M1"]["status"] == "Active"


def test_panel_round_trip_and_jobs(spark, tmp_path):
    clean = frame(spark, random_reports(21, 25))
    out = jobs.panel_job(clean, "2020-01-30", "2020-02-07")
    writers.write_panel(out["panel"], str(tmp_path / "panel"))
    back = readers.read_panel(spark, str(tmp_path / "panel"), "2020-01-31 00:00:00", "2020-02-02 00:00:00")
    assert back.count() == 2 * 48
    gen = out["panel"].select("timestamp", "eic_code", (F.col("installed_capacity") * 0.9).alias("actual_generation_mw"))
    stats = jobs.statistics(out["segments"], jobs.StatisticsOptions(counting_window="outage-span", min_outage_clusters=1, economic_shutdown_hours=5), gen)
    assert stats["fleet_Y"].count() == 1 and stats["blocks_M"].count() >= 2
    avg = jobs.availability_vs_generation(out["segments"], gen, only_restricted=True, max_cluster_days=300)
    assert avg["violation_hours"].count() > 0 and avg["daily"].count() > 0
    inv = jobs.inverse_availability(out["segments"], gen, clean)
    assert inv["recommendations"].count() == inv["segments"].count() > 0
    again = jobs.statistics(out["segments"], corrections=inv["masks"])
    assert again["correction_report"].collect()[0]["unmatched_correction_keys"] == 0
    dia = jobs.diagnose(out["segments"], gen, clean)
    assert dia["segments"].agg(F.sum("violation_hours")).collect()[0][0] == dia["violation_rows"].count()
    cmp_ = jobs.compare_panels(out["segments"], out["segments"])
    assert cmp_["monthly"].agg(F.sum("abs_label_delta_mwh")).collect()[0][0] == 0


def test_no_machine_local_folder_when_one_is_named(spark, tmp_path):
    from wattlens.session import materialise, shared_dir

    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert (named or str(tmp_path)) in shared_dir(spark)
    out = materialise(spark.range(5))
    assert out.count() == 5 and all(shared_dir(spark) in f for f in out.inputFiles())
