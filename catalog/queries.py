"""Registered queries: each one runs a library operator over the whole given tables.

``@query(name, sql)`` registers the Spark callable and, where there is one, its SQL twin.
Reports of the given tables span 1995-2001; the horizon covers all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wattlens.functions import binning, codes, text
from wattlens.functions.times import period_key
from wattlens.operators import bridging, capacity as cap, generation as gen, inverse, kpis, panel as pn, reports as rep, runs, tallies as tl, validation as val
from wattlens.plans import fixtures as fx
from wattlens.session import materialise

from .oracles import H, chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


HOUR_SUMS = {*tl.PARTIAL, *tl.FULL, "AH", "EAH"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that summation order cannot show (the shift keeps exact ties apart).
    Sums of many hourly shares carry more noise and keep four digits."""
    shift = lambda n: F.round(F.col(n) + 1e-7, 4) if n in HOUR_SUMS else F.round(F.col(n) + 1e-9, digits)
    return df.select(*[shift(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


# --- reports and capacity ---------------------------------------------------------------

@query("active_intervals", chain("iv") + """SELECT unit_eic, valid_from, valid_to, unit_installed_capacity FROM iv""")
def active_intervals(spark, d):
    return cap.active_intervals(fx.capacity(spark, d)).select("unit_eic", "valid_from", "valid_to", "unit_installed_capacity")


@query("asof_capacity", chain("at_start") + "SELECT unit_eic, mrid, version, start_out, end_out, start_derate, inst AS mw FROM at_start")
def asof_capacity(spark, d):
    r = rep.default_deration_window(fx.reports(spark, d).filter(rep.active_current()))
    iv = fx.intervals(spark, d).withColumnRenamed("unit_installed_capacity", "mw")
    return cap.asof_capacity(r, iv, ["unit_eic"], "start_derate").select(
        "unit_eic", "mrid", "version", "start_out", "end_out", "start_derate", "mw")


@query("scoped_mrids", chain("rep") + """, s AS (SELECT mrid, count(DISTINCT unit_eic) AS n FROM rep GROUP BY mrid)
SELECT CASE WHEN n > 1 THEN concat(rep.mrid, '__', unit_eic) ELSE rep.mrid END AS mrid, n > 1 AS mrid_cross_unit_duplicate,
       count(*) AS n_rows, max(version) AS max_version FROM rep JOIN s ON rep.mrid = s.mrid GROUP BY 1, 2""")
def scoped_mrids(spark, d):
    s = rep.scope_mrids(fx.view(spark, d, fx.REPORT_SQL).withColumn("unit_name", F.lit(None).cast("string")))
    return s.groupBy("mrid", "mrid_cross_unit_duplicate").agg(F.count(F.lit(1)).alias("n_rows"), F.max("version").alias("max_version"))


@query("mrid_duplicates", chain("r3") + """, c AS (SELECT mrid, count(*) n FROM r3 GROUP BY mrid)
SELECT outage_type, CASE WHEN regexp_matches(lower(reason), 'maintenance') THEN 'maintenance' ELSE 'other' END AS outage_reason, crossed AS mrid_cross_unit_duplicate,
       count(*) AS n_rows, count(DISTINCT r3.mrid) AS n_mrids FROM r3 JOIN c ON r3.mrid = c.mrid WHERE n > 1 OR crossed GROUP BY 1, 2, 3""")
def mrid_duplicates(spark, d):
    return fx.prepared(spark, d).mrid_dups.groupBy("outage_type", "outage_reason", "mrid_cross_unit_duplicate").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("mrid").alias("n_mrids"))


_KEYS = "asset_type, mrid, unit_eic, start_out, end_out, start_derate, end_derate"


@query("current_version_rows", chain("clean") + f"SELECT {_KEYS}, version, installed_capacity, avail_capacity FROM (SELECT *, inst AS installed_capacity FROM clean)")
def current_version_rows(spark, d):
    return fx.clean(spark, d).select(*_KEYS.split(", "), "version", "installed_capacity", "avail_capacity")


@query("single_record_rows", chain("rep") + """SELECT mrid, version, unit_eic, update_time, avail_capacity FROM (
  SELECT *, row_number() OVER (PARTITION BY mrid ORDER BY version DESC, update_time DESC, avail_capacity, old_version DESC, outage_type DESC,
    reason DESC, start_out DESC, end_out DESC, start_derate DESC, end_derate DESC, created_doc DESC, unit_eic DESC) rn
  FROM rep WHERE status = 'Active' AND old_version = 'false') WHERE rn = 1""")
def single_record_rows(spark, d):
    r = fx.view(spark, d, fx.REPORT_SQL).withColumn("asset_type", F.lit("GENERATION")).withColumn("document_sort_time", F.col("update_time"))
    r = r.select("mrid", "asset_type", "version", "document_sort_time", "avail_capacity", "status", "old_version", "outage_type", "reason",
                 "start_out", "end_out", "start_derate", "end_derate", "created_doc", "unit_eic", "update_time")
    return rep.current_records(r, mode="single_record").select("mrid", "version", "unit_eic", "update_time", "avail_capacity")


@query("latest_status_rows", chain("rep") + """, m AS (SELECT *, max(version) OVER (PARTITION BY mrid) mv FROM rep),
k AS (SELECT *, row_number() OVER (PARTITION BY mrid, unit_eic, start_out, end_out, start_derate, end_derate
      ORDER BY update_time DESC, CASE WHEN status = 'Active' AND old_version = 'false' THEN 1 ELSE 0 END, avail_capacity) rn FROM m WHERE version = mv)
SELECT mrid, unit_eic, version, start_derate, end_derate, avail_capacity FROM k WHERE rn = 1 AND status = 'Active' AND old_version = 'false'""")
def latest_status_rows(spark, d):
    r = fx.view(spark, d, fx.REPORT_SQL).withColumn("asset_type", F.lit("GENERATION")).withColumn("document_sort_time", F.col("update_time"))
    return rep.current_records(r, "latest-status").select("mrid", "unit_eic", "version", "start_derate", "end_derate", "avail_capacity")


@query("document_time_report", chain("rep") + """SELECT mrid, version, unit_eic, created_doc AS version_publication_time_before, update_time,
  epoch(created_doc) - epoch(update_time) AS publication_after_update_seconds FROM rep WHERE created_doc > update_time""")
def document_time_report(spark, d):
    return rep.document_time_report(fx.view(spark, d, fx.REPORT_SQL)).select(
        "mrid", "version", "unit_eic", "version_publication_time_before", "update_time", "publication_after_update_seconds")


@query("clip_bounds", chain("rep") + """SELECT mrid, version, unit_eic, start_derate AS start_derate_before, end_derate AS end_derate_before,
  greatest(start_derate, start_out) AS start_derate_after, least(end_derate, end_out) AS end_derate_after
  FROM rep WHERE start_derate < start_out OR end_derate > end_out""")
def clip_bounds(spark, d):
    return rep.bounds_report(fx.view(spark, d, fx.REPORT_SQL)).select(
        "mrid", "version", "unit_eic", "start_derate_before", "end_derate_before", "start_derate_after", "end_derate_after")


@query("horizon_clip", chain("rep") + """SELECT mrid, version, unit_eic, greatest(start_out, timestamp '1997-01-01') AS start_out, least(end_out, timestamp '2000-01-01') AS end_out,
  greatest(start_derate, timestamp '1997-01-01') AS start_derate, least(end_derate, timestamp '2000-01-01') AS end_derate
  FROM rep WHERE end_out > timestamp '1997-01-01' AND start_out < timestamp '2000-01-01'""")
def horizon_clip(spark, d):
    return rep.clip_horizon(fx.view(spark, d, fx.REPORT_SQL), "1997-01-01", "2000-01-01").select(
        "mrid", "version", "unit_eic", *rep.WINDOWS)


@query("inner_hour_bounds", chain("rep") + """SELECT mrid, version, unit_eic, start_out, end_out, sd AS start_derate, ed AS end_derate FROM (
  SELECT *, CASE WHEN date_trunc('hour', start_derate) = start_derate THEN start_derate ELSE date_trunc('hour', start_derate) + interval '1' hour END AS sd,
         date_trunc('hour', end_derate) AS ed FROM rep) WHERE end_out > start_out AND ed > sd""")
def inner_hour_bounds(spark, d):
    return rep.inner_hours(fx.view(spark, d, fx.REPORT_SQL)).select("mrid", "version", "unit_eic", *rep.WINDOWS)


@query("preparation_counters", chain("rep", "r1", "r4", "clean") + """, n AS (SELECT asset_type, mrid, count(*) n FROM clean GROUP BY 1, 2)
SELECT 'rows_before_area_type_filter' AS counter, count(*) AS value FROM rep UNION ALL SELECT 'rows_after_area_type_filter', count(*) FROM rep
UNION ALL SELECT 'installed_capacity_missing_before_lookup', count(*) FROM r1
UNION ALL SELECT 'document_time_order_corrections', count(*) FROM rep WHERE status = 'Active' AND old_version = 'false' AND created_doc > update_time
UNION ALL SELECT 'ts_bounds_adjusted_rows', count(*) FROM r4 WHERE start_derate < start_out OR end_derate > end_out
UNION ALL SELECT 'horizon_clip_rows', 0 UNION ALL SELECT 'clean_rows', count(*) FROM clean
UNION ALL SELECT 'multi_interval_mrids', count(*) FROM n WHERE n > 1 UNION ALL SELECT 'multi_interval_rows', CAST(coalesce(sum(n), 0) AS BIGINT) FROM n WHERE n > 1""")
def preparation_counters(spark, d):
    return fx.prepared(spark, d).counters


@query("partition_listing", chain("clean") + """SELECT lower(asset_type) AS asset, area, plant_type_code, count(DISTINCT unit_eic) AS units FROM clean GROUP BY 1, 2, 3""")
def partition_listing(spark, d):
    return rep.partition_listing(fx.clean(spark, d))


@query("bridged_outage_windows", chain("work") + "SELECT unit_eic, mrid, start_out, end_out, start_derate FROM work")
def bridged_outage_windows(spark, d):
    return bridging.bridge_reports(fx.clean(spark, d), 8, 0).select("unit_eic", "mrid", "start_out", "end_out", "start_derate")


@query("deration_gap_bridges", chain("work") + """, o AS (SELECT *, lead({s}) OVER w AS n FROM (SELECT *, struct_pack(sd := start_derate, doc := doc, av := avail_capacity, mrid := mrid, ot := outage_type) AS s FROM work)
  WINDOW w AS (PARTITION BY unit_eic ORDER BY start_derate, doc, mrid, start_out, end_out, end_derate))
SELECT unit_eic, CASE WHEN doc > n.doc OR (doc = n.doc AND avail_capacity <= n.av) THEN mrid ELSE n.mrid END AS mrid, end_derate AS start_derate, n.sd AS end_derate,
  CASE WHEN doc > n.doc OR (doc = n.doc AND avail_capacity <= n.av) THEN avail_capacity ELSE n.av END AS avail_capacity
FROM o WHERE n IS NOT NULL AND n.sd > end_derate AND n.sd <= end_derate + interval '12' hour AND n.ot = outage_type""".replace("{s}", "s"))
def deration_gap_bridges(spark, d):
    w = bridging.bridge_reports(fx.clean(spark, d), 8, 12, same_type=True)
    return w.filter("is_deration_gap_bridge").select("unit_eic", "mrid", "start_derate", "end_derate", "avail_capacity")


# --- panel ------------------------------------------------------------------------------

@query("hourly_state", chain("hrs") + """SELECT unit_eic AS eic_code, date_trunc('month', h) AS month, st AS state, count(*) AS hours, sum(inst) AS installed_mwh, sum(av) AS available_mwh
FROM hrs GROUP BY 1, 2, 3""")
def hourly_state(spark, d):
    s = pn.capacity_segments(fx.clean(spark, d), fx.START, fx.END, fx.OPTIONS)
    h = runs.hours_col()
    return s.groupBy("eic_code", F.date_trunc("month", "seg_start").alias("month"), "state").agg(
        F.sum(h).alias("hours"), F.sum(F.col("installed_capacity") * h).alias("installed_mwh"),
        F.sum(F.col("avail_capacity") * h).alias("available_mwh"))


@query("attribution_labels", chain("panel") + """SELECT unit_eic AS eic_code, date_trunc('month', h) AS month, st AS state, ot AS outage_type, rs AS outage_reason, cr AS cluster_rule,
  count(*) AS hours, sum(inc) AS forced_mwh, sum(sched) AS scheduled_mwh, sum(po) AS po, sum(pm) AS pm, sum(fo) AS fo, sum(fm) AS fm FROM panel GROUP BY 1, 2, 3, 4, 5, 6""")
def attribution_labels(spark, d):
    h = runs.hours_col()
    tot = lambda c, n: F.sum(F.col(c) * h).alias(n)
    return fx.segments(spark, d).groupBy("eic_code", F.date_trunc("month", "seg_start").alias("month"), "state", "outage_type", "outage_reason", "cluster_rule").agg(
        F.sum(h).alias("hours"), tot("forced_increment_mw", "forced_mwh"), tot("scheduled_loss_mw", "scheduled_mwh"),
        tot("derate_mw_planned_other", "po"), tot("derate_mw_planned_maintenance", "pm"),
        tot("derate_mw_forced_other", "fo"), tot("derate_mw_forced_maintenance", "fm"))


@query("event_id_lists", chain("act", "hrs") + """, x AS (SELECT unit_eic, h, string_agg(mrid, '|' ORDER BY start_out, doc, mrid, start_derate) AS ids
  FROM (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY unit_eic, h, mrid ORDER BY start_out, doc, start_derate) = 1) GROUP BY 1, 2)
SELECT x.unit_eic AS eic_code, ids AS active_event_ids, count(*) AS hours FROM x GROUP BY 1, 2""")
def event_id_lists(spark, d):
    return fx.segments(spark, d).filter("active_event_ids <> ''").groupBy("eic_code", "active_event_ids").agg(F.sum(runs.hours_col()).alias("hours"))


@query("outage_clusters", chain("panel", "work") + f""", fs AS (SELECT DISTINCT unit_eic, unnest([start_out, start_derate]) AS h FROM work WHERE outage_type = 'Forced'),
k AS (SELECT p.*, concat(st, '|', coalesce(ot, ''), '|', coalesce(rs, ''), '|', cr) AS key, fs.h IS NOT NULL AND st <> 'avail' AND ot = 'Forced' AS hard
      FROM panel p LEFT JOIN fs ON p.unit_eic = fs.unit_eic AND p.h = fs.h),
c AS (SELECT *, CASE WHEN lag(key) OVER w IS NULL THEN st <> 'avail' ELSE key <> lag(key) OVER w END OR hard AS chg FROM k WINDOW w AS (PARTITION BY unit_eic ORDER BY h)),
i AS (SELECT *, sum(CASE WHEN chg THEN 1 ELSE 0 END) OVER (PARTITION BY unit_eic ORDER BY h) AS id FROM c)
SELECT unit_eic AS eic_code, CAST(id AS INTEGER) AS cluster_id, min(h) AS cluster_start, max(h) + {H} AS cluster_end_excl, CAST(count(*) AS DOUBLE) AS cluster_duration_h,
       any_value(ot) AS outage_type, any_value(cr) AS cluster_rule FROM i WHERE st <> 'avail' GROUP BY 1, 2""")
def outage_clusters(spark, d):
    return fx.segments(spark, d).filter("state <> 'avail'").groupBy(
        "eic_code", "cluster_id", "cluster_start", "cluster_end_excl", "cluster_duration_h", "outage_type", "cluster_rule").agg(
        F.lit(1).alias("_x")).drop("_x")


_PARTS = {"": "outage", "_planned": "pl", "_forced": "fc", "_maintenance": "mt", "_forced_nonmaintenance": "fo", "_planned_nonmaintenance": "po"}


@query("outage_sums_area_type", chain("panel") + """, p AS (SELECT *, least(greatest(inst - av, 0), inst) AS outage, po + pm AS pl, fo + fm AS fc, pm + fm AS mt FROM panel),
g AS (SELECT country, area, plant_type_code, h, sum(inst) AS i, count(DISTINCT unit_eic) AS n, """ + ", ".join(
    f"sum({c}) AS s_{c}, count(DISTINCT CASE WHEN {c} > 0 THEN unit_eic END) AS n_{c}" for c in _PARTS.values()) + """ FROM p GROUP BY 1, 2, 3, 4)
SELECT country, area, plant_type_code, date_trunc('month', h) AS month, count(*) AS hours, sum(i) AS sum_installed_capacity_mw, CAST(sum(n) AS BIGINT) AS count_units_total, """ + ", ".join(
    f"sum(s_{c}) AS sum_outage_mw{k}, CAST(sum(n_{c}) AS BIGINT) AS count_units{k or '_outage'}" for k, c in _PARTS.items()) + " FROM g GROUP BY 1, 2, 3, 4")
def outage_sums_area_type(spark, d):
    s = pn.outage_sums(fx.panel(spark, d))
    total = [c for c in s.columns if c.startswith(("sum_", "count_"))]
    return s.groupBy("country", "area", "plant_type_code", F.date_trunc("month", "timestamp").alias("month")).agg(
        F.count(F.lit(1)).alias("hours"), *[F.sum(c).alias(c) for c in total])


# --- tallies and KPIs -------------------------------------------------------------------

TALLY = [*tl.FULL, *tl.PARTIAL]


@query("unit_tallies", chain("tal") + """SELECT unit_eic AS eic_code, date_trunc('month', h) AS month, CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS active_hours, """ + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in tl.FULL) + ", " + ", ".join(f"round(sum({c}) + 1e-7, 4) AS {c}" for c in tl.PARTIAL) + " FROM tal GROUP BY 1, 2")
def unit_tallies(spark, d):
    h = runs.hours_col()
    return rounded(fx.tallies(spark, d).groupBy("eic_code", F.date_trunc("month", "seg_start").alias("month")).agg(
        F.sum(F.when(F.col("is_active"), h).otherwise(0)).alias("active_hours"), *[F.sum(F.col(c) * h).alias(c) for c in TALLY]))


_PERIOD_SQL = {
    "overall": "'ALL'", "M": "strftime(h, '%Y-%m')", "MOY": "strftime(h, '%m')", "Y": "strftime(h, '%Y')",
    "W": "strftime(h, '%G-W%V')", "WOY": "strftime(h, '%V')",
}
_EXPOSED = "active AND NOT (SOH > 0 OR ESDH > 0)"
_EVENT_SQL = {}
for _k in "FUPMS":
    _b = _EXPOSED if _k in "FU" else "active"
    _EVENT_SQL[f"{_k}O"] = f"({_b}) AND {_k}OH > 0"
    _EVENT_SQL[f"E{_k}O"] = f"({_b}) AND ({_k}OH > 0 OR E{_k}DH > 0)"
for _k in "FU":
    _EVENT_SQL[f"E{_k}D"] = f"({_EXPOSED}) AND E{_k}DH > 0"


def _kpi_sql(period: str, select: str, group: str = "") -> str:
    """Hour-level twin of the unit KPIs: run starts by lag inside (unit, period)."""
    w = "WINDOW w AS (PARTITION BY unit_eic, pk ORDER BY h)"
    flags = ", ".join(f"{c} AS f_{e}" for e, c in _EVENT_SQL.items())
    starts = ", ".join(f"f_{e} AND NOT coalesce(lag(f_{e}) OVER w AND lag(h) OVER w = h - {H}, false) AS s_{e}" for e in _EVENT_SQL)
    aggs = ", ".join(f"CAST(sum(CASE WHEN s_{e} THEN 1 ELSE 0 END) AS BIGINT) AS N_{e}, CAST(sum(CASE WHEN f_{e} THEN 1 ELSE 0 END) AS BIGINT) AS TOT_{e}_h" for e in _EVENT_SQL)
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in TALLY)
    mom = ", ".join(f"CAST(sum(CASE WHEN f_{e} THEN 1 ELSE 0 END) AS DOUBLE) AS {e}_H, sum(CASE WHEN f_{e} THEN d ELSE 0 END) AS {e}_S, sum(CASE WHEN f_{e} THEN d * d ELSE 0 END) AS {e}_Q, "
                    f"sum(CASE WHEN f_{e} THEN inst ELSE 0 END) AS {e}_HW, sum(CASE WHEN f_{e} THEN inst * d ELSE 0 END) AS {e}_SW" for e in ("EFD", "EUD"))
    wt = ", ".join(f"sum({e} * inst) AS {n}" for n, e in {
        "wah": "greatest((CASE WHEN active THEN 1 ELSE 0 END) - POH - MOH - FOH, 0)", "wact": "(CASE WHEN active THEN 1 ELSE 0 END)",
        "weah": "greatest((CASE WHEN active THEN 1 ELSE 0 END) - POH - MOH - FOH - EPDH - EMDH - EFDH, 0)", "wf": "FOH", "wef": "(FOH + EFDH)", "wp": "POH", "wep": "(POH + EPDH)"}.items())
    extra = {
        "k0": f"SELECT *, {_PERIOD_SQL[period]} AS pk, {flags} FROM tal",
        "k1": f"SELECT *, {starts} FROM k0 {w}",
        "k2": f"""SELECT country, plant_type_code, unit_name, unit_eic AS eic_code, pk AS period_key, CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS ACTH,
                  sum(CASE WHEN active THEN inst ELSE 0 END) AS cap_mwh, max(CASE WHEN active THEN inst ELSE 0 END) AS cap_nameplate, {sums}, {aggs}, {mom}, {wt} FROM k1 GROUP BY ALL""",
        "k3": "SELECT *, greatest(ACTH - POH - MOH - FOH, 0) AS AH, greatest(ACTH - POH - MOH - FOH - EPDH - EMDH - EFDH, 0) AS EAH, cap_mwh / nullif(ACTH, 0) AS cap_w FROM k2",
    }
    return chain("tal", extra=extra) + select


def _q(n: str, den: str, alias: str) -> str:
    return f"round(CASE WHEN {den} > 0 THEN CAST({n} AS DOUBLE) / ({den}) END + 1e-9, 6) AS {alias}"


_BLOCK_SELECT = "SELECT country, plant_type_code, unit_name, eic_code, period_key, ACTH, round(AH + 1e-7, 4) AS AH, round(EAH + 1e-7, 4) AS EAH, " + ", ".join([
    *(f"round({c} + 1e-7, 4) AS {c}" for c in TALLY), *(f"N_{e}, TOT_{e}_h" for e in kpis.EVENTS),
    _q("AH", "ACTH", "AF"), _q("EAH", "ACTH", "EAF"), _q("POH + MOH + FOH", "ACTH", "TOF"), _q("EAH", "ACTH", "ESF"),
    *(_q(f"{k}OH", "ACTH", f"{k}OF") for k in "PMFUS"), *(_q(f"{k}OH + E{k}DH", "ACTH", f"E{k}OF") for k in "PMFUS"),
    *(_q(f"{k}OH", f"AH + {k}OH", f"{k}OR") for k in "PMFUS"), *(_q(f"{k}OH + E{k}DH", f"AH + {k}OH + E{k}DH", f"E{k}OR") for k in "PMFUS"),
    _q("EFD_S", "EFD_H", "EFD_mw_mean"), "round(CASE WHEN EFD_H > 0 THEN sqrt(greatest(EFD_Q / EFD_H - (EFD_S / EFD_H) * (EFD_S / EFD_H), 0)) END + 1e-4, 2) AS EFD_mw_std",
    _q("N_EFO", "TOT_EFO_h", "RR_efo_h"), _q("N_EFO", "AH", "FR_efo_h"), _q("N_UO", "TOT_UO_h", "RR_un_h"), _q("N_SO", "TOT_SO_h", "RR_so_h"),
    _q("cap_mwh", "ACTH", "cap_weight_MW")]) + " FROM k3"
_BLOCK_COLS = ["country", "plant_type_code", "unit_name", "eic_code", "period_key", "ACTH", "AH", "EAH", *TALLY,
               *[x for e in kpis.EVENTS for x in (f"N_{e}", f"TOT_{e}_h")], "AF", "EAF", "TOF", "ESF",
               *[f"{k}OF" for k in "PMFUS"], *[f"E{k}OF" for k in "PMFUS"], *[f"{k}OR" for k in "PMFUS"], *[f"E{k}OR" for k in "PMFUS"],
               "EFD_mw_mean", "EFD_mw_std", "RR_efo_h", "FR_efo_h", "RR_un_h", "RR_so_h", "cap_weight_MW"]


def _block_query(period: str):
    def run(spark, d):
        b = kpis.block_kpis(fx.tallies(spark, d), period).select(*_BLOCK_COLS)
        return rounded(b.withColumn("_s", F.round(F.col("EFD_mw_std") + 1e-4, 2)).drop("EFD_mw_std")).withColumnRenamed("_s", "EFD_mw_std")
    return run


for _p, _n in (("M", "month"), ("Y", "year"), ("MOY", "month_of_year"), ("W", "week"), ("WOY", "week_of_year"), ("overall", "overall")):
    query(f"block_kpis_{_n}", _kpi_sql(_p, _BLOCK_SELECT))(_block_query(_p))

_FLEET_SELECT = "SELECT country, plant_type_code, period_key, CAST(sum(ACTH) AS BIGINT) AS ACTH, " + ", ".join([
    _q("greatest(sum(ACTH) - sum(POH + MOH + FOH), 0)", "sum(ACTH)", "uAF"),
    _q("greatest(sum(ACTH) - sum(POH + MOH + FOH + EPDH + EMDH + EFDH), 0)", "sum(ACTH)", "uEAF"),
    _q("sum(FOH)", "greatest(sum(ACTH) - sum(POH + MOH + FOH), 0) + sum(FOH)", "uFOR"), _q("sum(SOH + ESDH)", "sum(ACTH)", "uESOF"),
    _q("sum(wah)", "sum(wact)", "wAF"), _q("sum(weah)", "sum(wact)", "wEAF"), _q("sum(wef)", "sum(wact)", "wEFOF"), _q("sum(wep)", "sum(wact)", "wEPOF"),
    _q("sum(wf)", "sum(wah + wf)", "wFOR"), _q("sum(wp)", "sum(wah + wp)", "wPOR"),
    "CAST(count(DISTINCT CASE WHEN ACTH > 0 THEN eic_code END) AS DOUBLE) AS n_units", "round(sum(CASE WHEN ACTH > 0 THEN cap_nameplate ELSE 0 END), 0) AS cap_total_MW",
    *(_q(f"sum(N_{e})", f"sum(TOT_{e}_h)", f"RR_{e.lower()}_h") for e in kpis.EVENTS), *(_q(f"sum(N_{e})", "sum(AH)", f"FR_{e.lower()}_h") for e in kpis.EVENTS),
    *(_q(f"sum(N_{e} * coalesce(cap_w, 0))", f"sum(TOT_{e}_h * coalesce(cap_w, 0))", f"wRR_{e.lower()}_h") for e in kpis.EVENTS),
    _q("sum(EUD_S)", "sum(EUD_H)", "EUD_mw_mean"), _q("sum(EUD_SW)", "sum(EUD_HW)", "wEUD_mw_mean")]) + " FROM k3 GROUP BY 1, 2, 3"
_FLEET_COLS = ["country", "plant_type_code", "period_key", "ACTH", "uAF", "uEAF", "uFOR", "uESOF", "wAF", "wEAF", "wEFOF", "wEPOF", "wFOR", "wPOR", "n_units", "cap_total_MW",
               *[f"RR_{e.lower()}_h" for e in kpis.EVENTS], *[f"FR_{e.lower()}_h" for e in kpis.EVENTS], *[f"wRR_{e.lower()}_h" for e in kpis.EVENTS], "EUD_mw_mean", "wEUD_mw_mean"]


def _fleet_query(period: str):
    def run(spark, d):
        b = kpis.block_kpis(fx.tallies(spark, d), period, internal=True)
        return rounded(kpis.fleet_kpis(b, ["country", "plant_type_code"]).select(*_FLEET_COLS))
    return run


for _p, _n in (("Y", "year"), ("MOY", "month_of_year"), ("overall", "overall")):
    query(f"fleet_kpis_{_n}", _kpi_sql(_p, _FLEET_SELECT))(_fleet_query(_p))


@query("weekly_periods", """SELECT strftime(l_shipdate, '%G-W%V') AS week, strftime(l_shipdate, '%V') AS week_of_year, strftime(l_shipdate, '%Y-%m') AS month,
  strftime(l_shipdate, '%m') AS month_of_year, strftime(l_shipdate, '%Y') AS year, count(*) AS n FROM lineitem GROUP BY ALL""")
def weekly_periods(spark, d):
    fx.tables(spark, d)
    t = spark.table("lineitem")
    keys = {"week": "W", "week_of_year": "WOY", "month": "M", "month_of_year": "MOY", "year": "Y"}
    return t.groupBy(*[period_key("l_shipdate", p).alias(n) for n, p in keys.items()]).agg(F.count(F.lit(1)).alias("n"))


_RUN_SQL = f""", f AS (SELECT *, d > 0 AS o FROM tal), z AS (SELECT *, o AND NOT coalesce(lag(o) OVER w AND lag(h) OVER w = h - {H}, false) AS st0 FROM f
  WINDOW w AS (PARTITION BY unit_eic ORDER BY h)), y AS (SELECT *, sum(CASE WHEN st0 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_eic ORDER BY h) AS run FROM z)"""


@query("event_runs", chain("tal") + _RUN_SQL + f" SELECT unit_eic AS eic_code, min(h) AS start, max(h) + {H} AS end_excl, count(*) AS dur_h FROM y WHERE o GROUP BY unit_eic, run")
def event_runs(spark, d):
    return runs.event_table(fx.tallies(spark, d), ["eic_code"], F.col("derate_MW") > 0)


@query("event_metrics", chain("tal") + _RUN_SQL + """ SELECT unit_eic AS eic_code, CAST(sum(CASE WHEN st0 THEN 1 ELSE 0 END) AS BIGINT) AS "K", CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS "TOT_h",
  CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS "H", sum(CASE WHEN o THEN d ELSE 0 END) AS "S", sum(CASE WHEN o THEN d * d ELSE 0 END) AS "Q" FROM y GROUP BY 1""")
def event_metrics(spark, d):
    return runs.event_metrics(fx.tallies(spark, d), ["eic_code"], F.col("derate_MW") > 0, F.col("derate_MW"))


@query("outage_cluster_report", chain("tal") + _RUN_SQL + """ SELECT unit_eic AS eic_code, count(*) AS n_rows, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS outage_hours,
  CAST(sum(CASE WHEN st0 THEN 1 ELSE 0 END) AS BIGINT) AS outage_cluster_count, min(CASE WHEN o THEN h END) AS first_outage_timestamp, max(CASE WHEN o THEN h END) AS last_outage_timestamp,
  sum(CASE WHEN o THEN d ELSE 0 END) AS derate_mw_hour_sum, max(CASE WHEN o THEN d ELSE 0 END) AS derate_mw_hour_max FROM y GROUP BY 1""")
def outage_cluster_report(spark, d):
    return tl.cluster_report(fx.tallies(spark, d), ["eic_code"])


_WIN_SQL = _RUN_SQL + f""", b AS (SELECT eic_code, min(timestamp) AS g0, max(timestamp) AS g1, count(*) AS gh FROM gen WHERE actual_generation_mw > 0 GROUP BY 1),
s AS (SELECT unit_eic, max(CASE WHEN o AND run = 1 THEN h END) AS s0, max(CASE WHEN o THEN h END) AS e0, count(*) AS n FROM y GROUP BY 1),
w AS (SELECT s.*, b.*, {{start}} AS k0, {{end}} AS k1 FROM s LEFT JOIN b ON s.unit_eic = b.eic_code)
SELECT w.unit_eic AS eic_code, k0 AS keep_start, k1 AS keep_end, n AS n_rows, count(t.h) AS kept_rows FROM w LEFT JOIN tal t ON t.unit_eic = w.unit_eic AND t.h >= k0 AND t.h <= k1 GROUP BY 1, 2, 3, 4"""


def _bounds(spark, d):
    return gen.generation_bounds(gen.positive_hours(fx.gen(spark, d)))


def _window_query(mode: str):
    def run(spark, d):
        t = fx.tallies(spark, d)
        w = tl.counting_windows(t, mode, _bounds(spark, d), ["eic_code"])
        return tl.window_report(t, w, ["eic_code"]).select("eic_code", "keep_start", "keep_end", "n_rows", "kept_rows")
    return run


for _m, _s, _e in (("outage-span", "s0", "e0"), ("first-generation", "CASE WHEN s0 IS NOT NULL THEN least(s0, g0) END", "CASE WHEN s0 IS NOT NULL THEN greatest(e0, g1) END"),
                   ("generation-span", "g0", "g1")):
    query("counting_window_" + _m.replace("-", "_"), chain("tal", "gen") + _WIN_SQL.replace("{start}", _s).replace("{end}", _e))(_window_query(_m))


_KIND = "CASE WHEN d <= 0 THEN 'NONE' WHEN FOH > 0 OR EFDH > 0 THEN 'FO' WHEN MOH > 0 OR EMDH > 0 THEN 'MO' WHEN POH > 0 OR EPDH > 0 THEN 'PO' WHEN SOH > 0 OR ESDH > 0 THEN 'SO' WHEN UOH > 0 OR EUDH > 0 THEN 'UO' ELSE 'NONE' END"


@query("long_outage_clusters", chain("tal") + f""", f AS (SELECT *, {_KIND} AS kd FROM tal), g AS (SELECT *, row_number() OVER (PARTITION BY unit_eic ORDER BY h)
  - row_number() OVER (PARTITION BY unit_eic, kd ORDER BY h) AS isl FROM f)
SELECT unit_eic AS eic_code, kd AS outage_type, min(h) AS start, max(h) + {H} AS end_excl, CAST(count(*) AS DOUBLE) AS duration_h, count(*) AS n_rows FROM g
WHERE kd <> 'NONE' GROUP BY unit_eic, kd, isl HAVING count(*) >= 240""")
def long_outage_clusters(spark, d):
    return tl.long_outages(fx.tallies(spark, d), min_hours=240, keys=["eic_code"])[1]


@query("without_long_outages", chain("tal") + f""", f AS (SELECT *, {_KIND} AS kd FROM tal), g AS (SELECT *, row_number() OVER (PARTITION BY unit_eic ORDER BY h)
  - row_number() OVER (PARTITION BY unit_eic, kd ORDER BY h) AS isl FROM f), n AS (SELECT *, count(*) OVER (PARTITION BY unit_eic, kd, isl) AS c FROM g)
SELECT unit_eic AS eic_code, count(*) AS hours, sum(d) AS derated_mwh FROM n WHERE kd = 'NONE' OR c < 240 GROUP BY 1""")
def without_long_outages(spark, d):
    h = runs.hours_col()
    return tl.long_outages(fx.tallies(spark, d), min_hours=240, keys=["eic_code"])[0].groupBy("eic_code").agg(
        F.sum(h).alias("hours"), F.sum(F.col("derate_MW") * h).alias("derated_mwh"))


@query("input_qa", chain("panel") + """SELECT country, plant_type_code, unit_eic AS eic_code, unit_name, count(*) AS n_rows, min(h) AS timestamp_start, max(h) AS timestamp_end, count(DISTINCT h) AS n_unique_timestamps,
  CAST(sum(CASE WHEN av IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_avail_capacity_hours, CAST(sum(CASE WHEN av > inst THEN 1 ELSE 0 END) AS BIGINT) AS avail_gt_installed_hours,
  count(*) - count(DISTINCT h) AS duplicate_timestamp_rows, CAST(date_diff('hour', min(h), max(h)) + 1 - count(DISTINCT h) AS BIGINT) AS missing_hourly_timestamps FROM panel GROUP BY 1, 2, 3, 4""")
def input_qa(spark, d):
    return tl.input_qa(fx.panel(spark, d)).select(
        "country", "plant_type_code", "eic_code", "unit_name", "n_rows", "timestamp_start", "timestamp_end", "n_unique_timestamps",
        "missing_avail_capacity_hours", "avail_gt_installed_hours", "duplicate_timestamp_rows", "missing_hourly_timestamps")


@query("duplicate_unit_blocks", """SELECT o_custkey AS unit, o_orderpriority AS area, o_orderstatus AS psr, n AS rows_removed FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderpriority, o_orderstatus) rn
  FROM (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) n FROM orders GROUP BY 1, 2, 3)) WHERE rn > 1""")
def duplicate_unit_blocks(spark, d):
    fx.tables(spark, d)
    o = spark.table("orders").select(F.col("o_custkey").alias("eic_code"), F.col("o_orderpriority").alias("area"), F.col("o_orderstatus").alias("plant_type_code"),
                                     F.col("o_orderdate").alias("seg_start"), (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("seg_end"))
    _, removed = tl.dedup_units(o, "area", ["1-URGENT"])
    return removed.select(F.col("eic_code").alias("unit"), "area", F.col("plant_type_code").alias("psr"), "rows_removed")


# --- generation -------------------------------------------------------------------------

@query("generation_unit_hours", chain("gen") + "SELECT timestamp, eic_code, round(actual_generation_mw + 1e-9, 6) AS actual_generation_mw, actual_generation_obs_count FROM gen")
def generation_unit_hours(spark, d):
    raw = fx.view(spark, d, """SELECT ts - interval '26' year AS timestamp, value * 2 AS actual_generation_mw,
        concat('U', lpad(cast(user_id % (SELECT count(*) FROM supplier) AS varchar(20)), 5, '0')) AS eic_code FROM events""")
    return rounded(gen.unit_hour_means(raw).select("timestamp", "eic_code", "actual_generation_mw", "actual_generation_obs_count"))


@query("generation_bounds", chain("gen") + """SELECT eic_code, min(timestamp) AS first_generation_timestamp, max(timestamp) AS last_generation_timestamp, count(*) AS generation_hours
FROM gen WHERE actual_generation_mw > 0 GROUP BY 1""")
def generation_bounds(spark, d):
    return _bounds(spark, d).withColumn("generation_hours", F.col("generation_hours").cast("long"))


@query("positive_hours_by_share", chain("gen", "panel") + """, c AS (SELECT unit_eic, max(inst) AS cap FROM panel GROUP BY 1)
SELECT gen.eic_code, count(*) AS hours, round(sum(actual_generation_mw) + 1e-9, 6) AS mwh FROM gen JOIN c ON gen.eic_code = c.unit_eic WHERE actual_generation_mw >= cap * 0.3 GROUP BY 1""")
def positive_hours_by_share(spark, d):
    p = gen.positive_hours(fx.gen(spark, d), gen.unit_capacity(fx.panel(spark, d)), 0.3)
    return rounded(p.groupBy("eic_code").agg(F.count(F.lit(1)).alias("hours"), F.sum("actual_generation_mw").alias("mwh")))


_POS = ", pos AS (SELECT DISTINCT eic_code, timestamp FROM gen WHERE actual_generation_mw > 0)"


@query("service_hours", chain("tal", "gen") + _POS + """SELECT unit_eic AS eic_code, count(*) AS panel_rows, CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS active_hours,
  CAST(sum(CASE WHEN active AND POH + MOH + FOH <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS available_hours,
  CAST(sum(CASE WHEN active AND POH + MOH + FOH <= 0 AND pos.eic_code IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS service_hours
FROM tal LEFT JOIN pos ON tal.unit_eic = pos.eic_code AND tal.h = pos.timestamp GROUP BY 1""")
def service_hours(spark, d):
    _, r = tl.service_hours(fx.tallies(spark, d), gen.positive_hours(fx.gen(spark, d)), ["eic_code"])
    return r.drop("reserve_shutdown_hours")


@query("economic_shutdown_runs", chain("tal", "gen") + _POS + f""", c AS (SELECT tal.*, active AND d <= 0 AND pos.eic_code IS NULL AS c0 FROM tal LEFT JOIN pos ON tal.unit_eic = pos.eic_code AND tal.h = pos.timestamp),
g AS (SELECT *, row_number() OVER (PARTITION BY unit_eic ORDER BY h) - row_number() OVER (PARTITION BY unit_eic, c0 ORDER BY h) AS isl FROM c)
SELECT unit_eic AS eic_code, min(h) AS start, max(h) + {H} AS end_excl, count(*) AS duration_h FROM g WHERE c0 GROUP BY unit_eic, isl HAVING count(*) >= 48""")
def economic_shutdown_runs(spark, d):
    _, r = tl.economic_shutdown(fx.tallies(spark, d), gen.positive_hours(fx.gen(spark, d)), 48, ["eic_code"])
    return r.select("eic_code", "start", "end_excl", "duration_h")


@query("low_generation_units", chain("panel", "gen") + """, b AS (SELECT eic_code, count(*) AS n FROM gen WHERE actual_generation_mw > 0 GROUP BY 1)
SELECT unit_eic AS eic_code, count(*) AS panel_rows, coalesce(any_value(b.n), 0) AS generation_hours FROM panel LEFT JOIN b ON panel.unit_eic = b.eic_code GROUP BY 1 HAVING coalesce(any_value(b.n), 0) <= 90""")
def low_generation_units(spark, d):
    return tl.exclude_low_generation(fx.panel(spark, d), _bounds(spark, d), 90)[1].select("eic_code", "panel_rows", "generation_hours")


@query("rare_generation_units", chain("tal", "gen") + _WIN_SQL.split("SELECT w.unit_eic")[0].replace("{start}", "s0").replace("{end}", "e0") + _POS.replace(", pos", ", pos2") +
       """, c AS (SELECT w.unit_eic, count(pos2.timestamp) AS n, any_value(date_diff('hour', k0, k1) + 1) AS p FROM w LEFT JOIN pos2 ON w.unit_eic = pos2.eic_code AND pos2.timestamp >= k0 AND pos2.timestamp <= k1 GROUP BY 1)
SELECT unit_eic AS eic_code, n AS generation_hours_in_period, p AS period_hours FROM c WHERE n / p < 0.0017""")
def rare_generation_units(spark, d):
    t = fx.tallies(spark, d)
    w = tl.counting_windows(t, "outage-span", None, ["eic_code"])
    c = gen.counts_in_windows(gen.positive_hours(fx.gen(spark, d)), w)
    return tl.exclude_rare_generation(t, w, c, 0.0017)[2].select("eic_code", "generation_hours_in_period", "period_hours")


# --- validation -------------------------------------------------------------------------

_CMP = """, cmp AS (SELECT p.*, g.actual_generation_mw AS raw, least(greatest(g.actual_generation_mw, 0), p.inst) AS used, greatest(2.0, p.inst * 0.01) AS tol
  FROM panel p JOIN gen g ON p.unit_eic = g.eic_code AND p.h = g.timestamp WHERE p.av < p.inst),
viol AS (SELECT *, used - av AS excess FROM cmp WHERE used - av > tol)"""
_TOL = dict(tol_mw=2.0, tol_rel=0.01)


def _violations(spark, d):
    return val.violation_hours(fx.compared(spark, d), fx.gen(spark, d), **_TOL)


@query("violation_hours", chain("panel", "gen") + _CMP + """SELECT unit_eic AS eic_code, h AS timestamp, country, inst AS cmp_installed, av AS cmp_available, round(used + 1e-9, 6) AS actual_generation_used_mw,
  round(excess + 1e-9, 6) AS excess_generation_mw, round(excess - tol + 1e-9, 6) AS excess_generation_above_tolerance_mw, round(100.0 * used / inst + 1e-9, 6) AS generation_factor_pct FROM viol""")
def violation_hours(spark, d):
    return rounded(_violations(spark, d).select("eic_code", "timestamp", "country", "cmp_installed", "cmp_available", "actual_generation_used_mw", "excess_generation_mw",
                                                "excess_generation_above_tolerance_mw", "generation_factor_pct"))


@query("violation_segments", chain("panel", "gen") + _CMP + f""", z AS (SELECT *, CASE WHEN lag(h) OVER (PARTITION BY unit_eic ORDER BY h) = h - {H} THEN 0 ELSE 1 END AS nw FROM viol),
y AS (SELECT *, sum(nw) OVER (PARTITION BY unit_eic ORDER BY h) AS s FROM z)
SELECT concat(country, '|', asset_type, '|', plant_type_code, '|', unit_eic, '|', strftime(min(h), '%Y%m%d%H')) AS segment_id, count(*) AS violation_hours, max(h) + {H} AS segment_end_utc,
  max(inst) AS max_comparison_installed_capacity_mw, min(av) AS min_comparison_available_capacity_mw, round(max(raw) + 1e-9, 6) AS max_actual_generation_mw,
  round(sum(excess - tol) + 1e-9, 6) AS sum_excess_generation_above_tolerance_mwh FROM y GROUP BY country, asset_type, plant_type_code, unit_eic, s""")
def violation_segments(spark, d):
    s, _ = val.violation_segments(_violations(spark, d))
    return rounded(s.select("segment_id", "violation_hours", "segment_end_utc", "max_comparison_installed_capacity_mw", "min_comparison_available_capacity_mw",
                            "max_actual_generation_mw", "sum_excess_generation_above_tolerance_mwh"))


@query("violation_summary_monthly", chain("panel", "gen") + _CMP + """SELECT country, plant_type_code, date_trunc('month', h) AS month, count(*) AS violation_unit_hours, count(DISTINCT unit_eic) AS n_units,
  round(sum(excess - tol) + 1e-9, 6) AS excess_generation_mwh, round(max(excess) + 1e-9, 6) AS max_excess_generation_mw FROM viol GROUP BY 1, 2, 3""")
def violation_summary_monthly(spark, d):
    v = _violations(spark, d).withColumn("plant_type", F.col("plant_type_code"))
    return rounded(val.monthly_violations(v).withColumnRenamed("plant_type", "plant_type_code"))


_UY = """, pop AS (SELECT asset_type, country, plant_type_code, unit_eic, year(h) AS year, count(*) AS auh, sum(inst) AS imwh FROM panel WHERE av < inst GROUP BY 1, 2, 3, 4, 5),
co AS (SELECT asset_type, country, plant_type_code, unit_eic, year(h) AS year, count(*) AS obs, sum(CASE WHEN used - av > tol THEN 1 ELSE 0 END) AS vio, sum(used) AS gmwh,
  sum(CASE WHEN used - av > tol THEN used - av ELSE 0 END) AS xmwh, max(used - av) AS mx FROM cmp GROUP BY 1, 2, 3, 4, 5),
uy AS (SELECT pop.*, coalesce(obs, 0) AS obs, coalesce(vio, 0) AS vio, coalesce(gmwh, 0) AS gmwh, coalesce(xmwh, 0) AS xmwh, coalesce(mx, 0) AS mx FROM pop LEFT JOIN co USING (asset_type, country, plant_type_code, unit_eic, year))"""


def _unit_year(spark, d):
    p = fx.compared(spark, d, fx.panel).withColumn("plant_type", F.col("plant_type_code"))
    return val.unit_year_summary(p, val.compare_hours(p, fx.gen(spark, d), **_TOL))


@query("violation_unit_year", chain("panel", "gen") + _CMP + _UY + """SELECT asset_type, country, unit_eic AS eic_code, year, auh AS availability_unit_hours, imwh AS availability_installed_capacity_mwh, obs AS observed_generation_unit_hours,
  CAST(vio AS BIGINT) AS violation_unit_hours, round(gmwh + 1e-9, 6) AS generation_mwh, round(xmwh + 1e-9, 6) AS excess_generation_mwh, round(mx + 1e-9, 6) AS max_excess_generation_mw, round(obs / auh + 1e-9, 6) AS generation_coverage_share FROM uy""")
def violation_unit_year(spark, d):
    return rounded(_unit_year(spark, d).select(
        "asset_type", "country", "eic_code", F.col("year").cast("long").alias("year"), "availability_unit_hours", "availability_installed_capacity_mwh", "observed_generation_unit_hours",
        "violation_unit_hours", "generation_mwh", "excess_generation_mwh", "max_excess_generation_mw", "generation_coverage_share"))


@query("violation_country_type", chain("panel", "gen") + _CMP + _UY + """SELECT country, plant_type_code AS plant_type, count(DISTINCT unit_eic) AS n_units, count(DISTINCT CASE WHEN vio > 0 THEN unit_eic END) AS n_units_with_violations,
  CAST(sum(auh) AS BIGINT) AS availability_unit_hours, CAST(sum(vio) AS BIGINT) AS violation_unit_hours, round(sum(xmwh) + 1e-9, 6) AS excess_generation_mwh, round(CASE WHEN sum(obs) > 0 THEN sum(vio) / sum(obs) END + 1e-9, 6) AS violation_share_of_observed_hours
FROM uy GROUP BY 1, 2""")
def violation_country_type(spark, d):
    return rounded(val.roll_up(_unit_year(spark, d), ["country", "plant_type"]).select(
        "country", "plant_type", "n_units", "n_units_with_violations", "availability_unit_hours", "violation_unit_hours", "excess_generation_mwh", "violation_share_of_observed_hours"))


_AVG = """, c0 AS (SELECT p.country, p.plant_type_code, p.h, sum(p.inst) AS i, sum(p.av) AS a, count(*) AS n FROM panel p {where} GROUP BY 1, 2, 3),
g0 AS (SELECT p.country, p.plant_type_code, p.h, sum(least(greatest(g.actual_generation_mw, 0), p.inst)) AS g, count(*) AS m,
  sum(CASE WHEN least(g.actual_generation_mw, p.inst) - p.av > greatest(2.0, p.inst * 0.01) THEN least(g.actual_generation_mw, p.inst) - p.av ELSE 0 END) AS x
  FROM panel p JOIN gen g ON p.unit_eic = g.eic_code AND p.h = g.timestamp {where} GROUP BY 1, 2, 3),
hh AS (SELECT c0.*, least(coalesce(g, 0), i) AS g, coalesce(m, 0) AS m, coalesce(x, 0) AS x FROM c0 LEFT JOIN g0 USING (country, plant_type_code, h))
SELECT country, plant_type_code AS plant_type, CAST(h AS DATE) AS date, round(avg(i) + 1e-9, 6) AS installed_mw, round(avg(a) + 1e-9, 6) AS available_mw, round(avg(g) + 1e-9, 6) AS generation_mw, round(avg(x) + 1e-9, 6) AS generation_gt_available_mw,
  CAST(sum(n) AS BIGINT) AS unit_hours, CAST(sum(m) AS BIGINT) AS observed_generation_unit_hours, max(n) AS n_units, round(100.0 * avg(a) / avg(i) + 1e-9, 6) AS availability_factor_pct FROM hh GROUP BY 1, 2, 3"""
_AVG_COLS = ["country", "plant_type", "date", "installed_mw", "available_mw", "generation_mw", "generation_gt_available_mw", "unit_hours", "observed_generation_unit_hours", "n_units", "availability_factor_pct"]


@query("availability_vs_generation_daily", chain("panel", "gen") + _AVG.replace("{where}", ""))
def availability_vs_generation_daily(spark, d):
    p = val.compared_capacity(fx.panel(spark, d)).withColumn("plant_type", F.col("plant_type_code"))
    return rounded(val.daily(val.availability_vs_generation(p, fx.gen(spark, d), **_TOL)).select(*_AVG_COLS))


@query("active_restrictions_daily", chain("panel", "gen") + _AVG.replace("{where}", "WHERE p.av < p.inst"))
def active_restrictions_daily(spark, d):
    p = fx.compared(spark, d, fx.panel).withColumn("plant_type", F.col("plant_type_code"))
    return rounded(val.daily(val.availability_vs_generation(p, fx.gen(spark, d), **_TOL)).select(*_AVG_COLS))


# --- inverse search ---------------------------------------------------------------------

def _raw(spark, d):
    return fx.reports(spark, d)


def _scored(spark, d):
    """Violation segments, their hours and the ranked candidates; as in the job, each is written once."""
    key = (spark.sparkContext.applicationId, d, "scored")
    if key not in fx._built:
        s, h = val.violation_segments(materialise(_violations(spark, d)))
        s, h = materialise(s), materialise(h)
        fx._built[key] = (s, h, materialise(inverse.score_candidates(s, _raw(spark, d), window_hours=24, **_TOL)))
    return fx._built[key]


_SEG = _CMP + f""", z AS (SELECT *, CASE WHEN lag(h) OVER (PARTITION BY unit_eic ORDER BY h) = h - {H} THEN 0 ELSE 1 END AS nw FROM viol),
y AS (SELECT *, sum(nw) OVER (PARTITION BY unit_eic ORDER BY h) AS s FROM z),
seg AS (SELECT concat(country, '|', asset_type, '|', plant_type_code, '|', unit_eic, '|', strftime(min(h), '%Y%m%d%H')) AS segment_id, unit_eic, min(h) AS s0, max(h) + {H} AS s1, count(*) AS dur,
  max(inst) AS i, min(av) AS a, max(greatest(raw, 0)) AS g FROM y GROUP BY country, asset_type, plant_type_code, unit_eic, s),
cand AS (SELECT seg.*, r.mrid, r.version, lower(r.status) AS stn, r.old_version = 'true' AS old, r.start_derate AS c0, r.end_derate AS c1, r.created_doc, 0 AS syn,
  CASE WHEN lower(r.status) = 'cancelled' OR r.avail_capacity IS NULL THEN i ELSE least(greatest(r.avail_capacity, 0), i) END AS ea, r.avail_capacity AS ra
  FROM seg JOIN rep r ON seg.unit_eic = r.unit_eic AND r.start_derate < s1 + interval '24' hour AND r.end_derate > s0 - interval '24' hour AND r.end_derate > r.start_derate
  UNION ALL SELECT seg.*, '<NO_OUTAGE>', NULL, 'no_outage', false, s0, s1, NULL, 1, i, i FROM seg),
sc AS (SELECT *, greatest(least(g, i) - ea - greatest(2.0, i * 0.01), 0) AS resid, greatest(0, CAST(epoch_us(least(c1, s1)) - epoch_us(greatest(c0, s0)) AS DOUBLE) / 3.6e9) AS ov FROM cand),
sd AS (SELECT *, resid * 1000.0 + greatest(dur - ov, 0) * 10.0 + CASE WHEN syn = 1 THEN 50 WHEN stn = 'active' THEN 0 WHEN stn = 'cancelled' THEN 5 ELSE 25 END + CASE WHEN old THEN 20 ELSE 0 END
  + abs(ea - a) / greatest(i, 1) AS score FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY score, resid, greatest(dur - ov, 0), syn, c0, version NULLS LAST, created_doc NULLS LAST, mrid, c1, ra) AS rnk FROM sd)"""


@query("candidate_ranking", chain("panel", "gen", "rep") + _SEG + """SELECT segment_id, CAST(rnk AS INTEGER) AS score_rank, mrid AS candidate_mrid, stn AS candidate_status_norm, round(resid, 4) AS candidate_residual_excess_mw, round(ov, 4) AS candidate_overlap_hours,
  round(score, 3) AS candidate_score FROM rk""")
def candidate_ranking(spark, d):
    _, _, c = _scored(spark, d)
    return c.select("segment_id", "score_rank", "candidate_mrid", "candidate_status_norm", F.round("candidate_residual_excess_mw", 4).alias("candidate_residual_excess_mw"),
                    F.round("candidate_overlap_hours", 4).alias("candidate_overlap_hours"), F.round("candidate_score", 3).alias("candidate_score"))


@query("top_candidates", chain("panel", "gen", "rep") + _SEG + "SELECT segment_id, CAST(rnk AS INTEGER) AS score_rank, mrid AS candidate_mrid FROM rk WHERE rnk <= 5")
def top_candidates(spark, d):
    _, _, c = _scored(spark, d)
    return inverse.top_candidates(c, 5).select("segment_id", "score_rank", "candidate_mrid")


def _recommended(spark, d):
    s, h, c = _scored(spark, d)
    return inverse.recommend(s, c), h


_ACTION = """CASE WHEN resid <= 1e-9 AND syn = 1 THEN 'remove_or_ignore_current_outage' WHEN resid <= 1e-9 AND stn = 'cancelled' THEN 'respect_later_cancellation_or_withdrawal'
  WHEN resid <= 1e-9 THEN 'replace_with_candidate_raw_report' ELSE 'unresolved_by_raw_candidates' END"""


_RECS = f""", best AS (SELECT segment_id, unit_eic, s0, s1, mrid, resid, syn, stn, CASE WHEN syn = 1 THEN 'no_outage' WHEN stn IN ('cancelled', 'canceled', 'withdrawn') THEN 'cancelled_or_withdrawn' ELSE 'raw_report' END AS kind
  FROM rk WHERE rnk = 1),
sid AS (SELECT concat(country, '|', asset_type, '|', plant_type_code, '|', y.unit_eic, '|', strftime(min(y.h), '%Y%m%d%H')) AS segment_id, country, plant_type_code, count(*) AS vh, sum(excess - tol) AS mwh,
  coalesce(string_agg(DISTINCT oid, '|' ORDER BY oid), '') AS ids FROM y LEFT JOIN domids ON y.unit_eic = domids.unit_eic AND y.h = domids.h GROUP BY country, asset_type, plant_type_code, y.unit_eic, s),
recs AS (SELECT *, CASE WHEN resid <= 1e-9 AND same THEN 'keep_current_report_capacity_issue' ELSE {_ACTION} END AS action FROM (
  SELECT best.*, ids, vh, mwh, country, plant_type_code, list_contains(string_split(ids, '|'), mrid) AS same FROM best JOIN sid USING (segment_id)))"""
_RECOMMEND = chain("panel", "gen", "rep", "domids") + _SEG + _RECS


@query("recommendation_actions", _RECOMMEND + "SELECT segment_id, mrid AS candidate_mrid, kind AS candidate_kind, action AS recommended_action FROM recs")
def recommendation_actions(spark, d):
    r, _ = _recommended(spark, d)
    return r.select("segment_id", "candidate_mrid", "candidate_kind", "recommended_action")


@query("recommendations", _RECOMMEND + """SELECT segment_id, ids AS current_outage_ids, mrid AS candidate_mrid, kind AS candidate_kind, same AS candidate_same_as_current_report, action AS recommended_action FROM recs""")
def recommendations(spark, d):
    r, _ = _recommended(spark, d)
    return r.select("segment_id", "current_outage_ids", "candidate_mrid", "candidate_kind", "candidate_same_as_current_report", "recommended_action")


_TYPE = "CASE plant_type_code WHEN 'B04' THEN 'Fossil Gas' WHEN 'B05' THEN 'Fossil Hard coal' WHEN 'B14' THEN 'Nuclear' WHEN 'B12' THEN 'Hydro Water Reservoir' END"
_COUNTED = ", ".join([f"count(*) FILTER (WHERE action = '{a}') AS n_{a}" for a in (
    "keep_current_report_capacity_issue", "remove_or_ignore_current_outage", "respect_later_cancellation_or_withdrawal", "replace_with_candidate_raw_report", "unresolved_by_raw_candidates")]
    + [f"count(*) FILTER (WHERE kind = '{k}') AS candidates_{k}" for k in ("raw_report", "cancelled_or_withdrawn", "no_outage")])


@query("recommendation_breakdown", _RECOMMEND + f"""SELECT country, {_TYPE} AS plant_type, count(*) AS segments, CAST(sum(vh) AS BIGINT) AS violation_hours, round(sum(mwh) + 1e-9, 6) AS excess_generation_mwh, {_COUNTED} FROM recs GROUP BY 1, 2""")
def recommendation_breakdown(spark, d):
    return rounded(inverse.action_breakdown(_recommended(spark, d)[0], ["country", "plant_type"]))


@query("recommendation_distribution", _RECOMMEND + "SELECT action AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER () + 1e-9, 6) AS share FROM recs GROUP BY 1")
def recommendation_distribution(spark, d):
    return rounded(inverse.distribution(_recommended(spark, d)[0], "recommended_action"))


_MASK = f""", mk AS (SELECT y.*, recs.segment_id, recs.action, recs.kind, recs.mrid AS cm FROM y JOIN recs ON y.unit_eic = recs.unit_eic AND y.h >= recs.s0 AND y.h < recs.s1
  WHERE action IN ('remove_or_ignore_current_outage', 'respect_later_cancellation_or_withdrawal', 'unresolved_by_raw_candidates'))"""


@query("correction_masks", _RECOMMEND + _MASK + f"""SELECT h AS timestamp, country, asset_type, area, {_TYPE} AS plant_type, plant_type_code, unit_eic AS eic_code, unit_name, segment_id AS inverse_segment_id, action AS inverse_recommended_action,
  kind AS inverse_candidate_kind, cm AS inverse_candidate_mrid, true AS inverse_correction_flag, action = 'unresolved_by_raw_candidates' AS inverse_unreconstructable_flag, true AS set_availability_to_installed_capacity,
  inst AS corrected_available_capacity_mw, 1.0::DOUBLE AS corrected_availability_factor, round(greatest(raw, 0) + 1e-9, 6) AS actual_generation_mw, round(excess - tol + 1e-9, 6) AS excess_generation_above_tolerance_mw FROM mk""")
def correction_masks(spark, d):
    r, h = _recommended(spark, d)
    return rounded(inverse.correction_mask(h, r))


@query("latest_mrid_candidates", chain("rep") + """, n AS (SELECT mrid FROM rep GROUP BY 1 HAVING count(DISTINCT unit_eic) > 1),
sr AS (SELECT rep.* REPLACE (CASE WHEN n.mrid IS NULL THEN rep.mrid ELSE concat(rep.mrid, '__', unit_eic) END AS mrid) FROM rep LEFT JOIN n ON rep.mrid = n.mrid),
a AS (SELECT mrid, max(version) AS v FROM sr WHERE status = 'Active' AND old_version = 'false' GROUP BY 1),
l AS (SELECT sr.mrid, max(created_doc) AS c FROM sr JOIN a ON sr.mrid = a.mrid AND version = v WHERE status = 'Active' AND old_version = 'false' GROUP BY 1)
SELECT DISTINCT sr.* FROM sr JOIN a ON sr.mrid = a.mrid JOIN l ON sr.mrid = l.mrid
WHERE (status = 'Active' AND old_version = 'false' AND version = v) OR (status = 'Cancelled' AND created_doc > c)""")
def latest_mrid_candidates(spark, d):
    """A document on two units is two documents: ids are scoped first, as in the job."""
    r = fx.view(spark, d, fx.REPORT_SQL)
    return inverse.latest_mrid_rows(rep.scope_mrids(r.withColumn("unit_name", F.lit(None).cast("string")), keep_dealt=True)).select(*r.columns).distinct()


@query("register_name_keys", """SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(upper(p_brand), '[^0-9A-Z]+', '', 'g') AS brand_norm,
  CASE WHEN p_size >= 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'medium' WHEN p_size > 30 THEN 'large' END AS size_bin FROM part""")
def register_name_keys(spark, d):
    fx.tables(spark, d)
    return spark.table("part").select("p_partkey", text.unit_name_key("p_name").alias("key"), text.eic_norm("p_brand").alias("brand_norm"),
                                      binning.bins("p_size", [0, 10, 30, float("inf")], ["small", "medium", "large"]).alias("size_bin"))


_ = (codes, Window)
