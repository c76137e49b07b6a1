"""ANSI SQL twins of the registered queries, for DuckDB.

They work hour by hour where the library works on intervals, so the two sides share no
method. ``BASE`` chains common table expressions over the given tables.
"""

from __future__ import annotations

from wattlens.plans.fixtures import CAPACITY_SQL, END, GENERATION_SQL, REPORT_SQL, START, UNIT_SQL

H = "interval '1' hour"

CTES = {
    "u": UNIT_SQL,
    "cap": CAPACITY_SQL,
    "rep": REPORT_SQL,
    "gen": GENERATION_SQL,
    # active capacity intervals
    "cap1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_eic, valid_from ORDER BY update_time DESC, p_partkey DESC) rn FROM cap) WHERE rn = 1",
    "iv": """SELECT unit_eic, p_partkey, valid_from, valid_to, status, unit_installed_capacity, update_time FROM (
        SELECT unit_eic, p_partkey, valid_from, status, unit_installed_capacity, update_time,
               least(valid_to, lead(valid_from) OVER (PARTITION BY unit_eic ORDER BY valid_from)) AS valid_to FROM cap1)
        WHERE status = 'COMMISSIONED' AND unit_installed_capacity > 0 AND (valid_to IS NULL OR valid_to > valid_from)""",
    # cleaned reports
    "r1": """SELECT r.mrid, r.version, r.unit_eic, r.status, r.old_version, r.outage_type, r.reason, r.start_out, r.end_out,
               coalesce(r.start_derate, r.start_out) AS start_derate, coalesce(r.end_derate, r.end_out) AS end_derate,
               least(r.created_doc, r.update_time) AS created_doc, r.update_time AS doc, r.avail_capacity,
               u.unit_name, u.country, u.area, u.plant_type_code, u.asset_type
        FROM rep r JOIN u ON r.unit_eic = u.unit_eic WHERE lower(r.status) = 'active' AND r.old_version = 'false'""",
    "at_start": """SELECT r1.*, CASE WHEN iv.valid_to IS NULL OR r1.start_derate < iv.valid_to THEN iv.unit_installed_capacity END AS inst
        FROM r1 ASOF LEFT JOIN iv ON r1.unit_eic = iv.unit_eic AND r1.start_derate >= iv.valid_from""",
    "r2": "SELECT * REPLACE (least(avail_capacity, inst) AS avail_capacity) FROM at_start WHERE inst > 0",
    "shared": "SELECT mrid FROM r2 GROUP BY mrid HAVING count(DISTINCT unit_eic) > 1",
    "r3": """SELECT r2.* REPLACE (CASE WHEN s.mrid IS NULL THEN r2.mrid ELSE concat(r2.mrid, '__', r2.unit_eic) END AS mrid),
               r2.mrid AS original_mrid, s.mrid IS NOT NULL AS crossed
        FROM r2 LEFT JOIN shared s ON r2.mrid = s.mrid""",
    "r4": """SELECT * EXCLUDE (rn, mv) FROM (SELECT *,
               row_number() OVER (PARTITION BY asset_type, mrid, unit_eic, start_out, end_out, start_derate, end_derate
                                  ORDER BY doc DESC, avail_capacity ASC NULLS LAST) rn FROM (
               SELECT *, max(version) OVER (PARTITION BY asset_type, mrid) mv FROM r3) WHERE version = mv) WHERE rn = 1""",
    "r5": "SELECT * REPLACE (greatest(start_derate, start_out) AS start_derate, least(end_derate, end_out) AS end_derate) FROM r4",
    "r6": f"""SELECT * FROM (SELECT * REPLACE (
               date_trunc('hour', start_out + interval '3599999999' microsecond) AS start_out, date_trunc('hour', end_out) AS end_out,
               date_trunc('hour', start_derate + interval '3599999999' microsecond) AS start_derate, date_trunc('hour', end_derate) AS end_derate)
               FROM r5 WHERE end_out > timestamp '{START}' AND start_out < timestamp '{END}')
        WHERE end_out > start_out AND end_derate > start_derate""",
    "clean": """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
               PARTITION BY asset_type, mrid, unit_eic, start_out, end_out, start_derate, end_derate
               ORDER BY doc DESC, avail_capacity ASC NULLS LAST) rn FROM r6) WHERE rn = 1""",
    # outage gaps up to 8 h are bridged
    "work": """SELECT * EXCLUDE nxt REPLACE (CASE WHEN nxt > end_out AND nxt <= end_out + interval '8' hour THEN nxt ELSE end_out END AS end_out)
        FROM (SELECT *, lead(start_out) OVER (PARTITION BY unit_eic ORDER BY start_out, doc, mrid, end_out, start_derate, end_derate) nxt FROM clean)""",
    # hours
    "act": f"SELECT *, unnest(generate_series(start_derate, end_derate - {H}, {H})) AS h FROM work",
    "ctx": f"SELECT *, unnest(generate_series(start_out, end_out - {H}, {H})) AS h FROM work",
    "av": """SELECT unit_eic, h, min(avail_capacity) AS av FROM (
               SELECT unit_eic, h, avail_capacity, doc, max(doc) OVER (PARTITION BY unit_eic, h) md FROM act) WHERE doc = md GROUP BY 1, 2""",
    "inst_h": """SELECT unit_eic, h, inst FROM (SELECT unit_eic, h, inst, row_number() OVER (
               PARTITION BY unit_eic, h ORDER BY doc DESC, start_out, mrid, start_derate) rn FROM ctx) WHERE rn = 1""",
    "grid": f"""SELECT unit_eic, unnest(generate_series(timestamp '{START}', timestamp '{END}' - {H}, {H})) AS h
        FROM (SELECT DISTINCT unit_eic FROM work)""",
    "filled": """SELECT g.unit_eic, g.h, a.av AS av0, coalesce(
               first_value(i.inst IGNORE NULLS) OVER (PARTITION BY g.unit_eic ORDER BY g.h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
               last_value(i.inst IGNORE NULLS) OVER (PARTITION BY g.unit_eic ORDER BY g.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS inst
        FROM grid g LEFT JOIN inst_h i ON g.unit_eic = i.unit_eic AND g.h = i.h LEFT JOIN av a ON g.unit_eic = a.unit_eic AND g.h = a.h""",
    "hrs": """SELECT unit_eic, h, inst, coalesce(av0, inst) AS av,
               CASE WHEN inst > 0 AND coalesce(av0, inst) <= 0 THEN 'out' WHEN inst > 0 AND coalesce(av0, inst) < inst THEN 'derate' ELSE 'avail' END AS st
        FROM filled""",
    # planned/forced attribution of the non-available hours (reactive extension off)
    "links": """SELECT DISTINCT p.unit_eic, p.mrid, p.start_out, p.end_out, p.start_derate, p.created_doc FROM work p JOIN work f ON p.unit_eic = f.unit_eic
        WHERE p.outage_type = 'Planned' AND f.outage_type = 'Forced' AND p.start_out <= f.end_out + interval '8' hour
          AND p.end_out >= f.start_out - interval '8' hour AND p.created_doc > f.start_out""",
    "down": """SELECT a.unit_eic, a.h, a.mrid, a.outage_type, a.start_out, a.start_derate, a.created_doc, a.doc, a.avail_capacity, hrs.inst, hrs.av,
               l.mrid IS NOT NULL AS reactive,
               CASE WHEN regexp_matches(lower(a.reason), 'maintenance|overhaul|revision') THEN 'maintenance'
                    WHEN a.outage_type = 'Planned' AND a.start_derate - a.created_doc >= interval '168' hour
                         AND a.end_derate - a.start_derate >= interval '24' hour THEN 'maintenance' ELSE 'other' END AS rs
        FROM act a JOIN hrs ON a.unit_eic = hrs.unit_eic AND a.h = hrs.h AND hrs.st <> 'avail'
        LEFT JOIN links l ON a.unit_eic = l.unit_eic AND a.mrid = l.mrid AND a.start_out = l.start_out AND a.end_out = l.end_out
             AND a.start_derate = l.start_derate AND a.created_doc = l.created_doc AND a.outage_type = 'Planned'""",
    "thr": """SELECT *, min(CASE WHEN outage_type = 'Forced' THEN start_out END) OVER (PARTITION BY unit_eic, h) AS thr FROM down""",
    "kind": """SELECT *, CASE WHEN outage_type = 'Forced' THEN 'F'
                    WHEN thr IS NULL OR (NOT reactive AND created_doc <= thr - interval '8' hour) THEN 'B' ELSE 'X' END AS k FROM thr""",
    "newest": """SELECT *, max(doc) OVER (PARTITION BY unit_eic, h, k) AS md FROM kind""",
    "cur": """SELECT * FROM (SELECT *, min(avail_capacity) OVER (PARTITION BY unit_eic, h, k) AS mn FROM newest WHERE doc = md) WHERE avail_capacity = mn""",
    "side": """SELECT unit_eic, h, any_value(inst) inst, any_value(av) av,
               min(CASE WHEN k = 'B' THEN mn END) b_av, min(CASE WHEN k = 'F' THEN mn END) f_av,
               sum(CASE WHEN k = 'B' THEN 1 ELSE 0 END) bn, sum(CASE WHEN k = 'B' AND rs = 'maintenance' THEN 1 ELSE 0 END) bm,
               sum(CASE WHEN k = 'F' THEN 1 ELSE 0 END) fn, sum(CASE WHEN k = 'F' AND rs = 'maintenance' THEN 1 ELSE 0 END) fm
        FROM cur GROUP BY 1, 2""",
    "low": """SELECT unit_eic, h, arg_min(outage_type, o) AS t, sum(CASE WHEN rs = 'maintenance' THEN 1 ELSE 0 END) AS lm, count(*) AS ln FROM (
               SELECT *, row_number() OVER (PARTITION BY unit_eic, h ORDER BY start_out, doc, mrid, start_derate) AS o,
                      min(avail_capacity) OVER (PARTITION BY unit_eic, h) AS mn FROM down) WHERE avail_capacity = mn GROUP BY 1, 2""",
    "plan_now": """SELECT unit_eic, h, sum(CASE WHEN rs = 'maintenance' THEN 1 ELSE 0 END) pm, count(*) pn FROM (
               SELECT *, min(avail_capacity) OVER (PARTITION BY unit_eic, h) mn FROM (
               SELECT *, max(doc) OVER (PARTITION BY unit_eic, h) md FROM down WHERE outage_type = 'Planned') WHERE doc = md)
               WHERE avail_capacity = mn GROUP BY 1, 2""",
    "amount": """SELECT *, least(greatest(inst - coalesce(b_av, inst), 0), greatest(total - inc, 0)) AS sched FROM (
               SELECT *, least(greatest(coalesce(coalesce(b_av, inst) - f_av, 0), 0), inst - av) AS inc, inst - av AS total FROM side)""",
    "lab": """SELECT a.unit_eic, a.h, a.inc, a.sched, a.total,
               CASE WHEN a.inc > 1e-9 THEN 'Forced' WHEN a.sched > 1e-9 THEN 'Planned' WHEN a.total > 1e-9 THEN low.t END AS ot,
               CASE WHEN a.inc > 1e-9 THEN CASE WHEN a.fm * 2 >= a.fn THEN 'maintenance' ELSE 'other' END
                    WHEN a.sched > 1e-9 AND a.bn > 0 THEN CASE WHEN a.bm * 2 >= a.bn THEN 'maintenance' ELSE 'other' END
                    WHEN a.sched > 1e-9 THEN CASE WHEN p.pm * 2 >= p.pn THEN 'maintenance' ELSE 'other' END
                    WHEN a.total > 1e-9 THEN CASE WHEN low.lm * 2 >= low.ln THEN 'maintenance' ELSE 'other' END END AS rs,
               CASE WHEN a.inc > 1e-9 THEN 'forced_increment_over_planned' WHEN a.sched > 1e-9 THEN 'planned_baseline'
                    WHEN a.total > 1e-9 THEN 'active_derate_no_baseline' ELSE '' END AS cr,
               CASE WHEN a.bn > 0 AND a.bm * 2 >= a.bn THEN 1 ELSE 0 END AS base_maint, CASE WHEN a.fn > 0 AND a.fm * 2 >= a.fn THEN 1 ELSE 0 END AS forced_maint
        FROM amount a JOIN low ON a.unit_eic = low.unit_eic AND a.h = low.h LEFT JOIN plan_now p ON a.unit_eic = p.unit_eic AND a.h = p.h""",
    # ids of the reports that carry an hour's label, in reading order
    "domset": """SELECT unit_eic, h, mrid, start_out, doc, start_derate, k FROM cur WHERE k IN ('F', 'B')
        UNION ALL SELECT unit_eic, h, mrid, start_out, doc, start_derate, 'P' FROM (
               SELECT *, min(avail_capacity) OVER (PARTITION BY unit_eic, h) mn FROM (
               SELECT *, max(doc) OVER (PARTITION BY unit_eic, h) md FROM down WHERE outage_type = 'Planned') WHERE doc = md) WHERE avail_capacity = mn
        UNION ALL SELECT unit_eic, h, mrid, start_out, doc, start_derate, 'L' FROM (
               SELECT *, min(avail_capacity) OVER (PARTITION BY unit_eic, h) mn FROM down) WHERE avail_capacity = mn""",
    "domids": """SELECT unit_eic, h, string_agg(mrid, '|' ORDER BY start_out, doc, mrid, start_derate) AS oid FROM (
               SELECT d.* FROM domset d JOIN amount a ON d.unit_eic = a.unit_eic AND d.h = a.h
                    AND d.k = CASE WHEN a.inc > 1e-9 THEN 'F' WHEN a.sched > 1e-9 THEN CASE WHEN a.bn > 0 THEN 'B' ELSE 'P' END WHEN a.total > 1e-9 THEN 'L' END
               QUALIFY row_number() OVER (PARTITION BY d.unit_eic, d.h, d.mrid ORDER BY d.start_out, d.doc, d.start_derate) = 1) GROUP BY 1, 2""",
    "panel": """SELECT u.country, u.area, u.plant_type_code, u.asset_type, u.unit_name, hrs.unit_eic, hrs.h, hrs.inst, hrs.av, hrs.st, lab.ot, lab.rs,
               coalesce(lab.cr, '') AS cr, coalesce(lab.inc, 0) AS inc, coalesce(lab.sched, 0) AS sched,
               CASE WHEN lab.sched > 1e-9 AND base_maint = 0 THEN lab.sched ELSE 0 END AS po, CASE WHEN lab.sched > 1e-9 AND base_maint = 1 THEN lab.sched ELSE 0 END AS pm,
               CASE WHEN lab.inc > 1e-9 AND forced_maint = 0 THEN lab.inc ELSE 0 END AS fo, CASE WHEN lab.inc > 1e-9 AND forced_maint = 1 THEN lab.inc ELSE 0 END AS fm
        FROM hrs JOIN u ON hrs.unit_eic = u.unit_eic LEFT JOIN lab ON hrs.unit_eic = lab.unit_eic AND hrs.h = lab.h""",
    # hour tallies
    "t0": """SELECT *, inst - av AS d, CASE WHEN inst > 0 THEN (inst - av) / inst ELSE 0 END AS r, st <> 'avail' AND rs = 'maintenance' AS m,
               st <> 'avail' AND ot = 'Forced' AS uu, st <> 'avail' AND ot = 'Planned' AS ss, inst > 0 AS active FROM panel""",
    "t1": """SELECT *, coalesce(ss AND NOT coalesce(m, false), false) AS pp, coalesce(uu AND NOT coalesce(m, false), false) AS ff, coalesce(m, false) AS mm,
               coalesce(uu, false) AS u1, coalesce(ss, false) AS s1, st = 'out' AS full_, st = 'derate' AND r > 0 AND r < 1 - 1e-12 AS part_ FROM t0""",
    "tal": """SELECT country, plant_type_code, unit_name, unit_eic, h, inst, d, r, active, st, ot, rs, """ + ", ".join(
        f"CASE WHEN {c} AND full_ THEN 1 ELSE 0 END AS {k}OH, CASE WHEN {c} AND part_ THEN r ELSE 0.0 END AS E{k}DH"
        for k, c in (("P", "pp"), ("M", "mm"), ("F", "ff"), ("U", "u1"), ("S", "s1"))) + " FROM t1",
}

ORDER = list(CTES)
DEPS = {
    "u": [], "cap": [], "rep": [], "gen": [], "cap1": ["cap"], "iv": ["cap1"], "r1": ["rep", "u"], "at_start": ["r1", "iv"], "r2": ["at_start"],
    "shared": ["r2"], "r3": ["r2", "shared"], "r4": ["r3"], "r5": ["r4"], "r6": ["r5"], "clean": ["r6"], "work": ["clean"], "act": ["work"],
    "ctx": ["work"], "av": ["act"], "inst_h": ["ctx"], "grid": ["work"], "filled": ["grid", "inst_h", "av"], "hrs": ["filled"],
    "links": ["work"], "down": ["act", "hrs", "links"], "thr": ["down"], "kind": ["thr"], "newest": ["kind"], "cur": ["newest"],
    "side": ["cur"], "low": ["down"], "plan_now": ["down"], "amount": ["side"], "lab": ["amount", "low", "plan_now"],
    "domset": ["cur", "down"], "domids": ["domset", "amount"], "panel": ["hrs", "u", "lab"], "t0": ["panel"], "t1": ["t0"], "tal": ["t1"],
}


def chain(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding the named expressions and everything they need."""
    need: set[str] = set()

    def add(n: str) -> None:
        if n not in need:
            need.add(n)
            for d in DEPS[n]:
                add(d)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in ORDER if n in need]
    parts += [f"{n} AS MATERIALIZED ({q})" for n, q in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
