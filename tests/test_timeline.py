"""Interval sums, cuts, nested-bin joins and quantiles against hour-by-hour or sorted definitions."""

import datetime as dt
import random

import numpy as np
import pytest
from helpers import h
from pyspark.sql import functions as F

from wattlens.operators import inverse, overlap, quantiles as qt, rows as rw, tallies as tl, timeline as tm
from wattlens.operators.segments import to_hours


def spans(seed, n, keys=("A", "B", None), top=900):
    """Random intervals that cross month starts; the key may be NULL."""
    r = random.Random(seed)
    return [(r.choice(keys), h(a), h(a + r.choice([1, 2, 5, 60, 800])), r.choice([0.1, 33.333, 100.0, -7.25, None]), r.choice([1, 2, None])) for a in (r.randrange(top) for _ in range(n))]


SPANS = "k string, seg_start timestamp, seg_end timestamp, x double, n int"


def hours(row):
    t = row[1]
    while t < row[2]:
        yield t
        t += dt.timedelta(hours=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_sums_equal_hourly_sums(spark, seed):
    rows = spans(seed, 60) + [("B", h(5), h(5), 1.0, 1)]  # an empty interval adds nothing
    want = {}
    for r in rows:
        for t in hours(r):
            w = want.setdefault((r[0], t), [0.0, 0, 0, 0])
            w[0] += r[3] or 0.0
            w[1] += r[3] is not None
            w[2] += r[4] or 0
            w[3] += 1
    got = to_hours(tm.interval_sums(spark.createDataFrame(rows, SPANS), ["k"], {"x": F.col("x"), "y": F.col("x"), "n": F.col("n")}, nullable=("y",))).collect()
    assert len(got) == len(want)
    for r in got:
        x, nx, n, all_ = want[(r["k"], r["timestamp"])]
        assert abs(r["x"] - x) < 1e-8 and (r["y"] is None) == (nx == 0) and (r["n"], r["n_rows"]) == (n, all_)
        assert nx == 0 or abs(r["y"] - x) < 1e-8


def test_interval_sums_end_at_zero_and_take_empty_tables(spark):
    d = spark.createDataFrame([("A", h(0), h(3), 0.1, 1), ("A", h(1), h(2), 0.2, 1), ("A", h(4), h(5), 0.3, 1)], SPANS)
    got = [(r["seg_start"], r["seg_end"], r["x"], r["n_rows"]) for r in tm.interval_sums(d, ["k"], {"x": F.col("x")}).orderBy("seg_start").collect()]
    assert got == [(h(0), h(1), 0.1, 1), (h(1), h(2), 0.3, 2), (h(2), h(3), 0.1, 1), (h(4), h(5), 0.3, 1)]
    assert tm.interval_sums(d.limit(0), ["k"], {"x": F.col("x")}).count() == 0


def test_cut_by_runs(spark):
    r = random.Random(4)
    left = [r_[:4] for r_ in spans(4, 40, keys=("A", "B", ""))]
    hrs = sorted({(k, h(r.randrange(1000)), r.choice(["p", "q"])) for k in ("A", "B") for _ in range(300)})
    hrs = list({(k, t): (k, t, v) for k, t, v in hrs}.values())
    runs = tm.runs_of_hours(spark.createDataFrame(hrs, "k string, timestamp timestamp, v string"), ["k"], ["v"])
    d = spark.createDataFrame([(*x, i) for i, x in enumerate(left)], "k string, seg_start timestamp, seg_end timestamp, x double, i int")
    pieces = tm.cut_by(d, runs, {"k": F.col("k")}, ["v"])
    got = {(x["i"], x["timestamp"]): x["_run"] and x["_run"]["v"] for x in to_hours(pieces).collect()}
    have = {(k, t): v for k, t, v in hrs}
    assert got == {(i, t): have.get((x[0], t)) for i, x in enumerate(left) for t in hours(x)}
    assert pieces.count() < len(got)


@pytest.mark.parametrize("seed,slack", [(1, 0), (2, 0), (3, 5)])
def test_nested_bins_give_every_pair_once(spark, seed, slack):
    r = random.Random(seed)

    def side(n, p):
        return [(r.choice("AB"), f"{p}{i}", h(a), h(a + r.choice([0, 1, 3, 30, 200, 2000, 40_000]))) for i, a in enumerate(r.randrange(-3000, 3000) for _ in range(n))]

    a, b = side(60, "a"), side(60, "b")
    got = overlap.overlap_join(spark.createDataFrame(a, "k string, i string, a0 timestamp, a1 timestamp"), spark.createDataFrame(b, "k string, j string, b0 timestamp, b1 timestamp"),
                               ["k"], ("a0", "a1"), ("b0", "b1"), slack)
    s = dt.timedelta(hours=slack)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] - s < x[3] + s and y[2] < y[3] and x[2] - s < y[3] and y[2] < x[3] + s)
    assert sorted((x["i"], x["j"]) for x in got.select("i", "j").collect()) == want and len(want) > 50


def test_no_long_or_busy_side_meets_all(spark):
    """Ten thousand hours against a long interval and many short ones: pairs stay those that overlap."""
    hrs = spark.range(5000).select(F.lit("U").alias("eic_code"), (F.lit(h(0)) + F.make_interval(hours=F.col("id").cast("int"))).alias("timestamp"))
    iv = spark.range(5000).select(F.lit("U").alias("eic_code"), (F.lit(h(0)) + F.make_interval(hours=F.col("id").cast("int"))).alias("seg_start"), "id")
    iv = iv.withColumn("seg_end", F.col("seg_start") + F.expr("INTERVAL 1 HOUR"))
    got = overlap.match_hours(hrs, iv)
    assert got.count() == 5000 and got.filter("timestamp <> seg_start").count() == 0


def test_lowest_value_of_overlapping_series_by_hour(spark):
    rows = [(k or "C", s, e, x, i) for i, (k, s, e, x, _) in enumerate(spans(7, 40))]
    d = spark.createDataFrame(rows + [("single", h(0), h(9), 5.0, 99)], "eic_code string, seg_start timestamp, seg_end timestamp, avail_capacity double, i int")
    got = to_hours(tl.dedup_unit_hours(d)).collect()
    want = {}
    for r in rows:
        for t in hours(r):
            want.setdefault((r[0], t), []).append(r[3])
    assert len(got) == len(want) + 9 == len({(r["eic_code"], r["timestamp"]) for r in got})
    for r in got:
        if r["eic_code"] != "single":
            vals = [v for v in want[(r["eic_code"], r["timestamp"])] if v is not None]
            assert r["avail_capacity"] == (min(vals) if vals else None)
    assert tl.dedup_unit_hours(d).filter("i = 99").count() == 1  # a unit without overlap is not cut


def test_qa_counts_time_not_rows(spark):
    d = spark.createDataFrame([("c", "t", "u", "n", h(0), h(10), 5.0, 6.0), ("c", "t", "u", "n", h(5), h(12), None, -1.0), ("c", "t", "u", "n", h(20), h(21), 5.0, None), ("c", "t", "u", "n", None, None, 5.0, 5.0)],
                              "country string, plant_type_code string, eic_code string, unit_name string, seg_start timestamp, seg_end timestamp, installed_capacity double, avail_capacity double")
    r = tl.input_qa(d).first()
    assert (r["n_rows"], r["n_unique_timestamps"], r["invalid_timestamp_rows"], r["duplicate_timestamp_rows"], r["missing_hourly_timestamps"]) == (19, 13, 1, 5, 8)
    assert (r["missing_installed_capacity_hours"], r["missing_avail_capacity_hours"], r["negative_avail_capacity_hours"], r["avail_gt_installed_hours"]) == (7, 1, 7, 10)
    assert (r["timestamp_start"], r["timestamp_end"]) == (h(0), h(20))


def test_corrections_split_and_join_again(spark):
    p = spark.createDataFrame([("u", h(0), h(10), 10.0, 2.0, "out", "x"), ("u", h(10), h(40), 10.0, 4.0, "derate", "y"), ("v", h(0), h(40), 10.0, 4.0, "derate", "y")],
                              "eic_code string, seg_start timestamp, seg_end timestamp, installed_capacity double, avail_capacity double, state string, outage_id string")
    mask = spark.createDataFrame([("u", h(t), True, True, None) for t in range(5, 30)] + [("u", h(35), True, True, 7.0), ("u", h(36), False, True, 7.0), ("w", h(1), True, True, 1.0)],
                                 "eic_code string, timestamp timestamp, inverse_correction_flag boolean, set_availability_to_installed_capacity boolean, corrected_available_capacity_mw double")
    fixed = inverse.apply_corrections(p, mask)
    assert sorted(tuple(r[c] for c in ("eic_code", "seg_start", "seg_end", "avail_capacity", "state", "outage_id", "inverse_correction_applied")) for r in fixed.collect()) == [
        ("u", h(0), h(5), 2.0, "out", "x", False), ("u", h(5), h(30), 10.0, "avail", None, True), ("u", h(30), h(35), 4.0, "derate", "y", False),
        ("u", h(35), h(36), 7.0, "avail", None, True), ("u", h(36), h(40), 4.0, "derate", "y", False), ("v", h(0), h(40), 4.0, "derate", "y", False)]
    one = {r["timestamp"]: (r["avail_capacity"], r["state"]) for r in to_hours(fixed).filter("eic_code = 'u'").collect()}
    assert one == {h(t): (2.0, "out") if t < 5 else (10.0, "avail") if t < 30 else (7.0, "avail") if t == 35 else (4.0, "derate") for t in range(40)}
    r = inverse.correction_report(p, mask).first()
    assert (r["eligible_correction_rows"], r["matched_panel_rows"], r["unmatched_correction_keys"]) == (27, 26, 1)


@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles_are_exact(spark, weighted):
    rng = np.random.default_rng(6)
    rows = [(str(k) if k else None, None if rng.random() < 0.1 else float(v), int(w)) for k, n in ((0, 3000), (1, 7), (2, 1)) for v, w in zip(np.round(rng.normal(size=n), 2 if k else 6), rng.integers(0, 4, n))]
    d = spark.createDataFrame(rows + [("none", None, 1)], "k string, v double, w int")
    wanted = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.977, "e": 1.0}
    got = {r["k"]: r for r in qt.quantiles(d, ["k"], F.col("v"), wanted, F.col("w") if weighted else None).collect()}
    for k in {r[0] for r in rows}:
        vals = [v for x, v, w in rows if x == k and v is not None for _ in range(w if weighted else 1)]
        assert (k in got) == bool(vals)
        if vals:
            assert all(abs(got[k][n] - np.quantile(vals, p)) < 1e-12 for n, p in wanted.items())
    assert "none" not in got
    g = qt.with_quantiles(d.groupBy("k").agg(F.count("*").alias("n")), d, ["k"], F.col("v"), {"m": 0.5})
    assert g.count() == 4 and g.filter("k = 'none'").first()["m"] is None
    assert qt.with_quantiles(d.agg(F.count("*").alias("n")), d.limit(0), [], F.col("v"), {"m": 0.5}).first()["m"] is None


def test_best_row_takes_maps_and_ignores_row_order(spark):
    d = spark.createDataFrame([(1, 5.0, {"a": 1}, "x"), (1, 5.0, {"a": 2}, "y"), (1, 4.0, {"a": 3}, "z"), (2, None, None, "n")], "k int, o double, m map<string,int>, t string")
    one = rw.best_row(d, ["k"], [F.col("o")]).collect()
    two = rw.best_row(d.orderBy(F.desc("t")).repartition(3), ["k"], [F.col("o")]).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 2
