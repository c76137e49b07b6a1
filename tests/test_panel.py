import datetime as dt

import pytest

from helpers import T0, brute_panel, frame, h, hours_of, random_reports, report
from wattlens.operators import bridging, panel as pn, segments as sg
from wattlens.operators.segments import to_hours

START = T0.strftime("%Y-%m-%d %H:%M:%S")


def end(n):
    return h(n).strftime("%Y-%m-%d %H:%M:%S")


@pytest.mark.parametrize("seed,extension", [(1, True), (2, False), (3, True)])
def test_interval_labels_equal_hourly_rules(spark, seed, extension):
    """The interval method gives every hour the label the rules give hour by hour."""
    rows = random_reports(seed, 40)
    opts = pn.PanelOptions(max_outage_gap=0, reactive_extension=extension)
    segs = pn.build_segments(frame(spark, rows), START, end(200), opts)
    got, want = hours_of(segs), brute_panel(rows, 200, extension=extension)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g["state"], g["installed_capacity"], g["avail_capacity"]) == (w["state"], w["inst"], w["avail"]), k
        assert (g["outage_type"], g["cluster_rule"], g["dominant_event_ids"]) == (w["type"], w["rule"], w["dominant"]), (k, w)
        assert abs(g["forced_increment_mw"] - w["inc"]) < 1e-9 and abs(g["scheduled_loss_mw"] - w["sched"]) < 1e-9, k


def test_segments_tile_the_horizon(spark):
    segs = pn.build_segments(frame(spark, random_reports(5, 30)), START, end(200))
    spans = {}
    for r in segs.collect():
        spans.setdefault(r["eic_code"], []).append((r["seg_start"], r["seg_end"]))
        parts = sum(r[c] for c in pn.RULE_COLUMNS)
        assert parts <= r["total_derate_mw"] + 1e-9
    for s in spans.values():
        s.sort()
        assert s[0][0] == h(0) and s[-1][1] == h(200)
        assert all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_segments_join_across_months_and_busy_units(spark):
    """A unit with very many reports in one month gets the same rows as the hourly rules give."""
    rows = random_reports(6, 400)
    opts = pn.PanelOptions(max_outage_gap=0, reactive_extension=False)
    got, want = hours_of(pn.build_segments(frame(spark, rows), START, end(200), opts)), brute_panel(rows, 200, extension=False)
    assert {k: (g["state"], g["dominant_event_ids"]) for k, g in got.items()} == {k: (w["state"], w["dominant"]) for k, w in want.items()}
    marks = sg.bounds(bridging.with_unit_id(frame(spark, rows)), START, end(200)).collect()
    assert len(marks) == 4 and all(r["bounds"] == sorted(set(r["bounds"])) and len(r["bounds"]) <= 745 for r in marks)


def test_latest_document_and_ties(spark):
    base = [report("A", "Forced", (0, 10), (0, 10), -5, 50.0), report("B", "Forced", (0, 10), (0, 10), -5, 30.0)]
    assert hours_of(pn.build_segments(frame(spark, base), START, end(10)))[("U1", h(3))]["avail_capacity"] == 30
    missing = base + [report("C", "Forced", (0, 10), (0, 10), None, 70.0)]
    assert hours_of(pn.build_segments(frame(spark, missing), START, end(10)))[("U1", h(3))]["avail_capacity"] == 70
    newest_blank = base + [report("D", "Forced", (0, 10), (0, 10), -1, None)]
    assert hours_of(pn.build_segments(frame(spark, newest_blank), START, end(10)))[("U1", h(3))]["state"] == "avail"


def test_planned_then_forced_split(spark):
    rows = [report("P", "Planned", (0, 20), (0, 20), -100, 60.0), report("F", "Forced", (5, 15), (5, 15), 5, 20.0)]
    r = hours_of(pn.build_segments(frame(spark, rows), START, end(20)))[("U1", h(6))]
    assert (r["scheduled_loss_mw"], r["forced_increment_mw"], r["outage_type"]) == (40.0, 40.0, "Forced")


def test_extension_switch(spark):
    rows = [report("F", "Forced", (0, 5), (0, 5), 0, 20.0), report("P", "Planned", (5, 20), (5, 20), 3, 20.0)]
    on = hours_of(pn.build_segments(frame(spark, rows), START, end(20)))[("U1", h(10))]
    off = hours_of(pn.build_segments(frame(spark, rows), START, end(20), pn.PanelOptions(reactive_extension=False)))[("U1", h(10))]
    assert (on["outage_type"], off["outage_type"]) == ("Forced", "Planned")
    assert "reactive_planned" in on["type_warning"]


def test_outage_gap_limit(spark):
    rows = [report("A", "Forced", (0, 2), (0, 2), 0, 0.0), report("B", "Forced", (2, 4), (2, 4), 0, 0.0),
            report("C", "Forced", (12, 14), (12, 14), 0, 0.0), report("D", "Forced", (23, 25), (23, 25), 0, 0.0)]
    b = {r["mrid"]: r["end_out"] for r in bridging.bridge_reports(frame(spark, rows), 8).collect()}
    assert b == {"A": h(2), "B": h(12), "C": h(14), "D": h(25)}


def test_deration_gap_bridge_copies_newer_document(spark):
    rows = [report("A", "Forced", (0, 2), (0, 2), 0, 40.0), report("B", "Forced", (5, 8), (5, 8), 1, 10.0)]
    d = bridging.bridge_reports(frame(spark, rows), 0, 4)
    x = d.filter("is_deration_gap_bridge").collect()
    assert [(r["mrid"], r["start_derate"], r["end_derate"]) for r in x] == [("B", h(2), h(5))]
    p = hours_of(pn.build_segments(frame(spark, rows), START, end(10), pn.PanelOptions(max_deration_gap=4)))
    assert p[("U1", h(3))]["is_deration_gap_bridge"] and p[("U1", h(3))]["avail_capacity"] == 10


def test_panel_columns_and_sums(spark):
    clean = frame(spark, random_reports(7, 20))
    panel = pn.build_panel(clean, START, end(200))
    from wattlens.schema import PANEL_COLUMNS

    assert panel.columns == PANEL_COLUMNS
    segs = pn.build_segments(clean, START, end(200))
    s = {r["timestamp"]: r for r in pn.outage_sums(segs).collect()}
    hrs = to_hours(segs).collect()
    assert len(s) == 200 and all(r["count_units_total"] == 2 for r in s.values())
    at = h(50)
    assert s[at]["sum_outage_mw"] == sum(r["total_derate_mw"] for r in hrs if r["timestamp"] == at)
    assert isinstance(at, dt.datetime)
