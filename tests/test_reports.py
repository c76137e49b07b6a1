from helpers import collect, frame, h, report
from wattlens.operators import capacity as cap, reports as rep


def test_same_interval_keeps_later_document(spark):
    rows = [report("M", "Forced", (0, 9), (0, 9), 0, 10.0, version=1), report("M", "Forced", (0, 9), (0, 9), 1, 20.0, version=2),
            report("M", "Forced", (0, 9), (0, 9), 2, 30.0, version=2)]
    assert collect(rep.current_records(frame(spark, rows)), "version", "avail_capacity") == [(2, 30.0)]


def test_all_intervals_of_the_highest_version(spark):
    rows = [report("M", "Forced", (0, 9), (0, 4), 0, 10.0, version=2), report("M", "Forced", (0, 9), (5, 9), 0, 20.0, version=2),
            report("M", "Forced", (0, 9), (2, 3), 0, 5.0, version=1)]
    got = rep.current_records(frame(spark, rows))
    assert collect(got, "avail_capacity") == [(10.0,), (20.0,)]
    assert collect(rep.current_records(got), "avail_capacity") == collect(got, "avail_capacity")


def test_latest_status_lets_cancellation_win(spark):
    rows = [report("M", "Forced", (0, 9), (0, 9), 0, 10.0, version=1), report("M", "Forced", (0, 9), (0, 9), 1, 10.0, version=2, status="Cancelled")]
    assert rep.current_records(frame(spark, rows), "latest-status").count() == 0
    assert rep.current_records(frame(spark, rows), "active-filter-first").count() == 1


def test_single_record_and_tie_rule(spark):
    rows = [report("M", "Forced", (0, 9), (0, 9), 0, 10.0), report("M", "Forced", (1, 9), (1, 9), 0, 20.0)]
    low = rep.current_records(frame(spark, rows), mode="single_record")
    high = rep.current_records(frame(spark, rows), mode="single_record", tie="highest")
    assert (collect(low, "avail_capacity"), collect(high, "avail_capacity")) == ([(10.0,)], [(20.0,)])


def test_shared_mrid_is_scoped(spark):
    rows = [report("M", "Forced", (0, 9), (0, 9), 0, 10.0, unit="U1"), report("M", "Forced", (0, 9), (0, 9), 0, 10.0, unit="u-2"),
            report("N", "Forced", (0, 9), (0, 9), 0, 10.0)]
    assert collect(rep.scope_mrids(frame(spark, rows)), "mrid") == [("M__U1",), ("M__U_2",), ("N",)]


def test_document_time_repair_and_bounds(spark):
    rows = [report("M", "Forced", (2, 8), (0, 9), 5, 10.0, doc=3)]
    d = rep.repair_document_times(frame(spark, rows))
    assert collect(d, "created_doc", "document_sort_time") == [(h(3), h(3))]
    assert collect(rep.bound_deration(d), "start_derate", "end_derate") == [(h(2), h(8))]
    assert rep.bound_deration(d, "drop").count() == 0 and rep.bounds_report(d).count() == 1


def test_inner_hours(spark):
    rows = [report("M", "Forced", (0.5, 3.5), (0.5, 3.5), 0, 1.0), report("N", "Forced", (0.2, 0.9), (0.2, 0.9), 0, 1.0)]
    assert collect(rep.inner_hours(frame(spark, rows)), "mrid", "start_out", "end_out") == [("M", h(1), h(3))]


def test_newer_interval_hides_older_one(spark):
    iv = spark.createDataFrame([("U", h(0), h(10), 1.0), ("U", h(5), h(7), 2.0)], "unit_eic string, valid_from timestamp, valid_to timestamp, mw double")
    at = spark.createDataFrame([("U", h(2)), ("U", h(6)), ("U", h(8))], "unit_eic string, t timestamp")
    assert sorted(tuple(r) for r in cap.asof_capacity(at, iv, ["unit_eic"], "t").select("t", "mw").collect()) == [(h(2), 1.0), (h(6), 2.0), (h(8), None)]


def test_first_key_kind_decides_even_when_expired(spark):
    look = spark.createDataFrame([("plant_map", "U1", h(-100), h(-50), 5.0), ("eic", "U1", h(-100), None, 7.0), ("eic", "U2", h(-100), None, 8.0)],
                                 "key_kind string, key string, valid_from timestamp, valid_to timestamp, mw double")
    rows = frame(spark, [report("A", "Forced", (0, 9), (0, 9), 0, 10.0, unit="U1"), report("B", "Forced", (0, 9), (0, 9), 0, 10.0, unit="U2")])
    out = rep.installed_from_lookup(rows, look)
    assert {r["unit_eic"]: (r["installed_capacity"], r["avail_capacity"]) for r in out.collect()} == {"U1": (None, 10.0), "U2": (8.0, 8.0)}


def test_prepare_is_independent_of_row_order(spark):
    from helpers import random_reports

    rows = random_reports(11, 30)
    run = lambda r: collect(rep.prepare_reports(frame(spark, r), start="2020-01-30", end="2020-02-20", check_areas=False).clean, "mrid", "start_out", "end_derate")
    assert run(rows) == run(rows[::-1])
