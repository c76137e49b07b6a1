"""Small frames and an hour-by-hour definition of the panel written in plain Python."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

T0 = dt.datetime(2020, 1, 30)


def h(n: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=n)


SCHEMA = ("mrid string, version long, status string, old_version string, outage_type string, reason string, unit_eic string, unit_name string, "
          "area_code string, area string, area_type string, country string, asset_type string, plant_type string, plant_type_code string, "
          "start_out timestamp, end_out timestamp, start_derate timestamp, end_derate timestamp, created_doc timestamp, update_time timestamp, "
          "document_sort_time timestamp, avail_capacity double, installed_capacity double")


def report(mrid, kind, out, derate, created, avail, unit="U1", inst=100.0, doc=None, version=1, status="Active", reason="Failure", old="false"):
    return (mrid, version, status, old, kind, reason, unit, unit, "A", "A", "BZN", "DE", "GENERATION", "Nuclear", "B14",
            h(out[0]), h(out[1]), h(derate[0]), h(derate[1]), h(created) if created is not None else None,
            h(doc if doc is not None else created) if (doc is not None or created is not None) else None,
            h(doc if doc is not None else created) if (doc is not None or created is not None) else None, avail, inst)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_reports(seed: int, n: int, span: int = 200):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = r.randrange(0, span - 40)
        b = a + r.randrange(1, 40)
        c, d = a + r.randrange(0, 3), b - r.randrange(0, 3)
        if d <= c:
            c, d = a, b
        rows.append(report(f"M{i:03d}", r.choice(["Planned", "Forced"]), (a, b), (c, d), a + r.randrange(-60, 12), r.choice([0.0, 20.0, 50.0, 80.0, None]),
                           unit=r.choice(["U1", "U2"]), inst=r.choice([100.0, 120.0]), reason=r.choice(["Failure", "Overhaul"])))
    return rows


def collect(df, *cols):
    return sorted(tuple(x) for x in df.select(*cols).collect())


def hours_of(df):
    from wattlens.operators.segments import to_hours

    return {(x["eic_code"], x["timestamp"]): x for x in to_hours(df).collect()}


def brute_panel(rows, span, delta=8, extension=True, tie=min):
    """Labels per unit-hour, straight from the rules, one hour at a time."""
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    recs = [dict(zip(names, r)) for r in rows]
    out = {}
    d = dt.timedelta(hours=delta)
    for unit in {r["unit_eic"] for r in recs}:
        mine = sorted((r for r in recs if r["unit_eic"] == unit), key=lambda r: (r["start_out"], r["document_sort_time"], r["mrid"]))
        inst, avail = [None] * span, [None] * span
        for t in range(span):
            ctx = [r for r in mine if r["start_out"] <= h(t) < r["end_out"]]
            act = [r for r in mine if r["start_derate"] <= h(t) < r["end_derate"]]
            if ctx:
                top = max(r["document_sort_time"] for r in ctx)
                inst[t] = next(r for r in ctx if r["document_sort_time"] == top)["installed_capacity"]
            if act:
                top = max(r["document_sort_time"] for r in act)
                vals = [r["avail_capacity"] for r in act if r["document_sort_time"] == top and r["avail_capacity"] is not None]
                avail[t] = tie(vals) if vals else None
        for t in range(span - 2, -1, -1):
            inst[t] = inst[t] if inst[t] is not None else inst[t + 1]
        for t in range(1, span):
            inst[t] = inst[t] if inst[t] is not None else inst[t - 1]

        def cur(rs):
            if not rs:
                return []
            top = max(r["document_sort_time"] for r in rs)
            now = [r for r in rs if r["document_sort_time"] == top and r["avail_capacity"] is not None]
            low = min((r["avail_capacity"] for r in now), default=None)
            return [r for r in now if r["avail_capacity"] == low]

        forced = [r for r in mine if r["outage_type"] == "Forced"]
        had = {r["mrid"]: False for r in forced}
        for f in forced:
            for t in range(span):
                if not (f["start_derate"] <= h(t) < f["end_derate"]) or f["avail_capacity"] is None:
                    continue
                known = [p for p in mine if p["outage_type"] == "Planned" and p["start_derate"] <= h(t) < p["end_derate"] and p["created_doc"] <= f["start_out"] - d]
                base = inst[t]
                if known:
                    c = cur(known)
                    base = c[0]["avail_capacity"] if c else None
                if base is not None and f["avail_capacity"] < base - 1e-9:
                    had[f["mrid"]] = True
        link = {}
        for p in mine:
            if p["outage_type"] == "Planned":
                near = [f for f in forced if p["start_out"] <= f["end_out"] + d and p["end_out"] >= f["start_out"] - d]
                link[p["mrid"]] = [f for f in near if p["created_doc"] > f["start_out"]]
        for t in range(span):
            i, a = inst[t], avail[t] if avail[t] is not None else inst[t]
            st = "out" if i > 0 and a <= 0 else "derate" if i > 0 and a < i else "avail"
            act = [r for r in mine if r["start_derate"] <= h(t) < r["end_derate"]]
            row = {"state": st, "inst": i, "avail": a, "type": None, "inc": 0.0, "sched": 0.0, "rule": "", "dominant": ""}
            if act and st != "avail":
                planned = [r for r in act if r["outage_type"] == "Planned"]
                fc = [r for r in act if r["outage_type"] == "Forced"]
                rea = [p for p in planned if link[p["mrid"]]]
                ext = [p for p in rea if any(had[f["mrid"]] for f in link[p["mrid"]])] if extension else []
                cand = fc + ext
                starts = [f["start_out"] for f in fc] + [f["start_out"] for p in ext for f in link[p["mrid"]]]
                if starts:
                    base = [p for p in planned if not link[p["mrid"]] and p["created_doc"] <= min(starts) - d]
                else:
                    base = planned
                bc, f_now = cur(base), cur(cand)
                b_av = bc[0]["avail_capacity"] if bc else i
                total = max(i - a, 0)
                inc = min(max(b_av - f_now[0]["avail_capacity"], 0), total) if f_now else 0.0
                sched = min(max(i - b_av, 0), max(total - inc, 0))
                row["inc"], row["sched"] = inc, sched
                if inc > 1e-9:
                    row["type"], dom = "Forced", f_now
                    row["rule"] = "reactive_planned_after_forced_increment" if ext and not fc else "forced_increment_over_planned"
                elif sched > 1e-9:
                    row["type"], dom = "Planned", bc or cur(planned)
                    row["rule"] = "planned_sequence_reactive_no_forced_increment" if not fc and rea and extension else "planned_baseline"
                else:
                    low = min((r["avail_capacity"] for r in act if r["avail_capacity"] is not None), default=None)
                    dom = [r for r in act if low is not None and r["avail_capacity"] == low]
                    row["type"], row["rule"] = (dom[0]["outage_type"] if dom else None), "active_derate_no_baseline"
                row["dominant"] = "|".join(r["mrid"] for r in sorted(dom, key=lambda r: (r["start_out"], r["document_sort_time"], r["mrid"])))
            out[(unit, h(t))] = row
    return out


def utc(df):
    return df.withColumn("timestamp", F.col("timestamp"))
