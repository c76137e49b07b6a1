"""What panels and preparations write on the way: few shuffles, no lists that nobody reads."""

from datetime import datetime

from pyspark.sql import functions as F

from helpers import collect, frame
from wattlens import session
from wattlens.operators import bridging, compare, overlap, panel as pn, reports as rep
from wattlens.plans import fixtures as fx

START, END = "2020-01-01", "2020-03-01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reports(spark):
    t = datetime.fromisoformat
    row = lambda m, k, a, b: dict(mrid=m, unit_eic=f"U{k}", asset_type="GENERATION", area_code="A", area="A", country="DE", plant_type="Nuclear", plant_type_code="B14",
                                  start_out=t(a), end_out=t(b), start_derate=t(a), end_derate=t(b), outage_type="Forced", reason="Failure", avail_capacity=10.0, installed_capacity=100.0,
                                  created_doc=t("2020-01-01"), update_time=t("2020-01-01"), document_sort_time=t("2020-01-01"), status="Active", old_version="false", version=1)
    return frame(spark, [row("M1", 1, "2020-01-03", "2020-01-05"), row("M1", 2, "2020-01-03", "2020-01-05"), row("M2", 1, "2020-01-05 03:00:00", "2020-02-07")])


def dealt(text, by):
    return sum("Exchange hashpartitioning(" in x and all(c in x.split("Exchange")[1].split("),")[0] for c in by) for x in text.splitlines())


def test_labels_need_no_lists_of_reports_and_segments_are_not_dealt_again(spark):
    text = plan(pn.build_segments(reports(spark), START, END, fx.OPTIONS).select(*fx.PANEL))
    assert "collect_list" not in text and dealt(text, ["seg_start"]) == 0


def test_intervals_of_a_document_are_chosen_where_it_was_dealt(spark):
    scoped = rep.scope_mrids(reports(spark), keep_dealt=True)
    assert sorted(r["mrid"] for r in scoped.collect()) == ["M1__U1", "M1__U2", "M2"]
    text = plan(rep.distinct_intervals(rep.current_records(scoped)))
    assert text.count("Exchange hashpartitioning(") == 1


def test_document_key_is_left_by_scoping(spark):
    ids = [" M1 ", "M1_", "M1__U2", "M_1___", "__", "", None]
    df = spark.createDataFrame([(m, u) for m in ids for u in ("U1", "U2")], "mrid string, unit_eic string")
    rows = rep.scope_mrids(df, keep_dealt=True).collect()
    again = {r["mrid"]: r[rep.DOC] for r in rep.by_document(spark.createDataFrame([(r["mrid"],) for r in rows], "mrid string")).collect()}
    assert all(again[r["mrid"]] == r[rep.DOC] for r in rows) and len(rows) == 14


def test_tables_on_the_way_to_a_result_go(spark):
    made = []
    out = session.settled(lambda: made.append(session.materialise(spark.range(7))) or made[0].filter("id > 2"))
    assert sorted(r["id"] for r in out.collect()) == [3, 4, 5, 6]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made[0].inputFiles()[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert session.settled(lambda: session.materialise(spark.range(3))).count() == 3


def test_bins_of_classes_that_do_not_occur_are_left_out(spark):
    a = spark.createDataFrame([("u", 0, 5), ("u", 100, 160), ("v", 0, 2)], "k string, a int, b int").selectExpr("k", "timestamp_seconds(a * 3600) s0", "timestamp_seconds(b * 3600) s1")
    b = a.selectExpr("k", "s0 + interval 1 hour t0", "s1 + interval 1 hour t1")
    met = lambda looked_up: sorted(map(str, overlap.overlap_join(a, b, ["k"], ("s0", "s1"), ("t0", "t1"), looked_up=looked_up).collect()))
    assert met(True) == met(False) and len(met(True)) == 3
    sec = a.selectExpr("unix_seconds(s0) x", "unix_seconds(s1) y")
    assert overlap._with_bins(sec, "x", "y", overlap.WIDTHS, "all", F.array(F.lit(0), F.lit(1))).filter("_level > 1").count() == 0


def test_label_changes_of_runs(spark):
    def side(kinds):
        rows = [("u", "DE", "B14", f"2020-01-01 0{h}:00:00", f"2020-01-01 0{h + 1}:00:00", 100.0, 40.0, t, "other") for h, t in enumerate(kinds)]
        return spark.createDataFrame(rows, "eic_code string, country string, plant_type_code string, a string, b string, installed_capacity double, avail_capacity double, outage_type string, outage_reason string").selectExpr(
            "*", "timestamp(a) seg_start", "timestamp(b) seg_end")

    got = compare.label_changes(side(["Forced"] * 4 + ["Planned"] * 3), side(["Forced"] * 2 + ["Planned"] * 5)).collect()
    assert [(r["month"], r["changed_mwh"]) for r in got] == [("2020-01", 120.0)]


def test_gap_bridges_of_equal_starts(spark):
    rows = [("A", "M1", 0, 5, 10.0), ("A", "M2", 0, 6, 20.0), ("A", "M3", 8, 9, 30.0), ("A", "M0", 8, 12, 5.0), ("A", "M4", 30, 31, 1.0)]
    at = lambda c: f"timestamp'2020-01-01' + make_interval(0, 0, 0, 0, {c}) AS "
    df = spark.createDataFrame(rows, "unit_id string, mrid string, s int, e int, avail_capacity double").selectExpr(
        "unit_id", "mrid", at("s") + "start_out", at("e") + "end_out", at("s") + "start_derate", at("e") + "end_derate", "avail_capacity",
        "timestamp'2020-01-01' document_sort_time", "'Forced' outage_type", "'x' reason")
    got = bridging.deration_bridges(df, 12).collect()
    assert [(r["mrid"], r["start_derate"].hour, r["end_derate"].hour, r["avail_capacity"]) for r in got] == [("M0", 6, 8, 5.0)]
    text = plan(bridging.bridge_outage_windows(df, 8))
    assert dealt(text, ["start_out"]) <= 2


_ = collect
