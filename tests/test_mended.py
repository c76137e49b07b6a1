"""Cases that once gave wrong answers: mixed inputs, blank keys, unknown values, repeated masks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattlens.operators import compare, inverse, kpis, registers, reports
from wattlens.operators.panel import PanelOptions, with_capacity
from wattlens.plans import jobs
from wattlens.sources import readers, writers

from helpers import frame, random_reports


def test_old_and_new_headers_in_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MRID\tAssetCode\tReason\nM1\tU1\tx\n")
    (tmp_path / "b.csv").write_text("AssetCode\tInstanceCode\tReason\nU2\tM2\ty\n")
    got = {r["mrid"]: (r["unit_eic"], r["reason"]) for r in readers.read_reports(spark, str(tmp_path)).collect()}
    assert got == {"M1": ("U1", "x"), "M2": ("U2", "y")}


def test_both_parquet_spellings_are_read(spark, tmp_path):
    at = dt.datetime(2020, 1, 30, 5)
    spark.createDataFrame([(at, "U1", 5.0)], "timestamp timestamp, eic_code string, actual_generation_mw double").write.parquet(str(tmp_path / "t/one"))
    spark.createDataFrame([(at, "U2", 7.0)], "`DateTime (UTC)` timestamp, GenerationUnitCode string, `ActualGenerationOutput(MW)` double").write.parquet(str(tmp_path / "t/two"))
    d = readers.read_generation_parquet(spark, [str(tmp_path / "t/one"), str(tmp_path / "t/two")], "2020-01-30", "2020-01-31")
    assert {(r["eic_code"], r["actual_generation_mw"]) for r in d.collect()} == {("U1", 5.0), ("U2", 7.0)}


def test_plant_key_is_the_first_column_that_holds_a_value(spark):
    d = spark.createDataFrame([("u1", "", "P", "DE", "a"), ("u2", None, "P", "DE", "b")], "unit_eic string, plant_eic_norm string, plant_eic string, country string, unit_name string").withColumn("plant_name", F.col("unit_name"))
    assert [r[0] for r in d.select(registers.plant_key(d)).collect()] == ["P", "P"]


def test_unknown_year_has_no_age(spark):
    d = spark.createDataFrame([("u1", "DE", "Gas", "B04", "x", None, None, 5.0), ("u2", "DE", "Gas", "B04", "x", None, 2000.0, 5.0)],
                              "unit_eic string, country string, fuel_type string, fuel_type_code string, technology string, set string, year_commissioned double, unit_installed_capacity double")
    got = {r["eic_code"]: (r["age_years"], r["age_class"]) for r in kpis.plant_dimension(d, 2020, [0, 10, 30], ["new", "old"], [0, 10], ["s"]).collect()}
    assert got["u1"] == (None, None) and got["u2"] == (20.0, "old")


def test_our_own_fleet_table_feeds_the_comparison(spark):
    out = jobs.panel_job(frame(spark, random_reports(21, 25)), "2020-01-30", "2020-02-07")
    fleet = jobs.statistics(out["segments"], jobs.StatisticsOptions(periods=("M",)))["fleet_M"]
    annual = compare.annual_from_monthly(fleet)
    assert annual.count() == 1 and annual.first()["acth"] > 0
    days = compare.outage_days(annual)
    assert {"FOD", "EFOD"} <= set(days.columns) and days.first()["FOD"] is not None


def test_rows_without_area_type_count_as_the_wanted_one(spark):
    from wattlens.functions import codes

    area = next(iter(codes.AREAS.values()))
    d = spark.createDataFrame([(area, None), (area, "CTA"), (area, "BZN")], "area_code string, area_type string")
    assert reports.allowed_areas(d, "CTA").count() == 2


def test_the_last_of_repeated_mask_rows_wins(spark):
    at = dt.datetime(2020, 1, 1)
    hours = spark.createDataFrame([("u", at, 10.0, 2.0, "out")], "eic_code string, timestamp timestamp, installed_capacity double, avail_capacity double, state string")
    mask = spark.createDataFrame([("u", at, True, True, 9.0, 1), ("u", at, True, True, 4.0, 2)],
                                 "eic_code string, timestamp timestamp, inverse_correction_flag boolean, set_availability_to_installed_capacity boolean, corrected_available_capacity_mw double, mask_order int")
    assert inverse.apply_corrections(hours, mask).first()["avail_capacity"] == 4.0


def test_report_without_rows_removes_an_earlier_one(spark, tmp_path):
    path, d = tmp_path / "r", spark.range(3)
    assert writers.write_report(d, str(path)) and path.exists()
    assert not writers.write_report(d.filter("id > 9"), str(path)) and not path.exists()


def test_candidates_are_not_capped_unless_asked():
    assert inverse.score_candidates.__defaults__[-1] is None


def test_unknown_tie_rule_is_refused(spark):
    with pytest.raises(ValueError, match="tie"):
        with_capacity(spark.range(1), PanelOptions(tie="newest"))


def test_match_statistics_count_all_rows(spark):
    jrc = spark.createDataFrame([("A", "P", "Solar", None), ("B", "P", "Fossil Gas", None), ("C", None, "Fossil Gas", None)],
                                "eic_g string, eic_p string, type_g string, year_commissioned double").selectExpr(
        "*", "eic_g AS name_g", "eic_p AS name_p", "'DE' AS country", "'x' AS NUTS2", "cast(NULL AS double) AS lat", "cast(NULL AS double) AS lon",
        "1.0D AS capacity_g", "1.0D AS capacity_p", "cast(NULL AS double) AS year_decommissioned")
    ppm = spark.createDataFrame([("1", "A"), ("2", "P")], "ppm_id string, ppm_eic string").selectExpr(
        "*", "1.0D AS ppm_capacity", "'CCGT' AS technology", "'PP' AS set", "'b' AS bus", "1.0D AS lat", "2.0D AS lon", "'2000' AS date_in", "cast(NULL AS string) AS date_out")
    got = registers.match_statistics(registers.match_registers(jrc, ppm)).first()
    assert tuple(got) == (1, 1, 1)
    assert registers.integrate_registers(jrc, ppm).count() == 1


def test_double_readings_do_not_break_runs(spark):
    from wattlens.operators import validation as val

    at = dt.datetime(2020, 1, 1)
    one = lambda i, x: ("DE", "GENERATION", "DE", "Gas", "B04", "u", "U", at + dt.timedelta(hours=i), x)
    cols = "country string, asset_type string, area string, plant_type string, plant_type_code string, eic_code string, unit_name string, timestamp timestamp, excess_generation_above_tolerance_mw double"
    more = ["outage_id", "state", "outage_type", "outage_reason"]
    nums = ["installed_capacity", "avail_capacity", "cmp_installed", "cmp_available", "actual_generation_mw", "actual_generation_capped_mw", "generation_above_installed_mw"]
    d = spark.createDataFrame([one(0, 5.0), one(1, 5.0), one(1, 7.0), one(2, 5.0)], cols).select("*", *[F.lit("x").alias(c) for c in more], *[F.lit(1.0).alias(c) for c in nums])
    seg, hours = val.violation_segments(d.withColumn("seg_start", F.col("timestamp")).withColumn("seg_end", F.col("timestamp")))
    assert [(r["violation_hours"], r["sum_excess_generation_above_tolerance_mwh"]) for r in seg.collect()] == [(3, 17.0)] and hours.count() == 3


def test_scope_and_options_of_the_inverse_job(spark):
    segs = jobs.panel_job(frame(spark, random_reports(21, 25)), "2020-01-30", "2020-02-07")["segments"]
    gen = jobs.to_hours(segs).select("timestamp", "eic_code", (F.col("installed_capacity") * 0.9).alias("actual_generation_mw"))
    out = jobs.inverse_availability(segs, gen, frame(spark, random_reports(21, 25)), countries=["nowhere"])
    assert out["segments"].count() == 0 and out["recommendations"].count() == 0
    none = jobs.inverse_availability(segs, gen, frame(spark, random_reports(21, 25)), min_share=0.95)
    assert none["segments"].count() == 0
