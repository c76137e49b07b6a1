"""Registered queries, second part: diagnosis, registers, comparison, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlens.functions import text
from wattlens.operators import capacity as cap, compare, diagnose as dg, inverse, references, registers as rg, runs, tallies as tl, validation as val
from wattlens.plans import fixtures as fx
from wattlens.schema import PLANT_MAP, conform
from wattlens.session import materialise

from .oracles import chain
from .queries import _CMP, _MASK, _RECS, _SEG, _TOL, _recommended, query, rounded

JRC_SQL = """
SELECT concat('C', cast(c_custkey AS varchar(20))) AS eic_g, concat('P', cast(c_custkey % 200 AS varchar(20))) AS eic_p, c_name AS name_g,
       concat('Plant ', cast(c_custkey % 200 AS varchar(20))) AS name_p,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Fossil Gas' WHEN 'MACHINERY' THEN 'Nuclear' WHEN 'AUTOMOBILE' THEN 'Fossil Hard coal' WHEN 'FURNITURE' THEN 'B02' ELSE 'Solar' END AS type_g,
       cast(floor(abs(c_acctbal)) AS double) AS capacity_g, cast(NULL AS double) AS capacity_p, n_name AS country,
       cast(c_custkey % 50 AS double) + 1 AS lat, cast(c_custkey % 70 AS double) - 20 AS lon, cast(NULL AS varchar(5)) AS NUTS2,
       CASE WHEN c_custkey % 3 = 0 THEN cast(1960 + c_custkey % 50 AS double) END AS year_commissioned, cast(NULL AS double) AS year_decommissioned
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
PPM_SQL = """
SELECT cast(p_partkey AS varchar(20)) AS ppm_id, concat('{''C', cast(p_partkey * 3 AS varchar(20)), ''', ''P', cast(p_partkey % 200 AS varchar(20)), '''}') AS ppm_eic,
       cast(floor(p_retailprice) AS double) AS ppm_capacity, p_type AS technology, CASE WHEN p_size % 4 = 0 THEN 'CHP' END AS set, p_brand AS bus,
       cast(p_size AS double) AS lat, cast(p_size AS double) AS lon, concat(cast(1950 + p_size AS varchar(20)), '-05-01') AS date_in, cast(NULL AS varchar(5)) AS date_out
FROM part
"""
PLANT_MAP_SQL = """
SELECT concat('UN', cast(p_partkey AS varchar(20))) AS unit_eic, concat('UN', cast(p_partkey AS varchar(20))) AS unit_eic_norm, concat('PL-', cast(p_partkey % 37 AS varchar(20))) AS plant_eic,
       concat('PL', cast(p_partkey % 37 AS varchar(20))) AS plant_eic_norm, concat('Block ', cast(p_partkey AS varchar(20))) AS unit_name,
       concat('Power Station ', cast(p_partkey % 37 AS varchar(20))) AS plant_name, concat('G', cast(p_partkey % 90 AS varchar(20))) AS ppm_id,
       cast(floor(p_retailprice) AS double) AS unit_installed_capacity, cast(1950 + p_size AS double) AS year_commissioned,
       CASE WHEN p_size % 2 = 0 THEN cast(1990 + p_partkey % 20 AS double) END AS year_decommissioned, p_type AS technology, p_brand AS country, p_type AS fuel_type
FROM part
"""


def _plant_map(spark, d):
    return conform(fx.view(spark, d, PLANT_MAP_SQL), PLANT_MAP)


# --- registers --------------------------------------------------------------------------

@query("register_match", f"""WITH j AS ({JRC_SQL}), p0 AS ({PPM_SQL}), p1 AS (SELECT *, unnest(regexp_extract_all(ppm_eic, '[A-Za-z0-9-]+')) AS eic FROM p0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eic ORDER BY CASE WHEN set IS NULL THEN 0 ELSE 1 END DESC, ppm_id DESC) rn FROM p1) WHERE rn = 1),
m AS (SELECT j.*, CASE WHEN u.eic IS NOT NULL THEN 'unit_eic' WHEN p.eic IS NOT NULL THEN 'plant_eic' END AS src, coalesce(u.technology, p.technology) AS tech,
  coalesce(j.year_commissioned, year(cast(coalesce(u.date_in, p.date_in) AS date))) AS yc FROM j LEFT JOIN p u ON j.eic_g = u.eic LEFT JOIN p ON j.eic_p = p.eic)
SELECT eic_g AS unit_eic, src AS eic_match_source, tech AS technology, yc AS year_commissioned, yc + 45 AS year_decommissioned,
  CASE type_g WHEN 'Fossil Gas' THEN 'B04' WHEN 'Nuclear' THEN 'B14' WHEN 'Fossil Hard coal' THEN 'B05' ELSE type_g END AS fuel_type_code FROM m WHERE type_g <> 'Solar' AND yc IS NOT NULL""")
def register_match(spark, d):
    j = rg.integrate_registers(fx.view(spark, d, JRC_SQL), fx.view(spark, d, PPM_SQL))
    return j.select("unit_eic", "eic_match_source", "technology", "year_commissioned", "year_decommissioned", "fuel_type_code")


@query("register_match_statistics", f"""WITH j AS ({JRC_SQL}), p0 AS ({PPM_SQL}), p AS (SELECT DISTINCT unnest(regexp_extract_all(ppm_eic, '[A-Za-z0-9-]+')) AS eic FROM p0),
m AS (SELECT u.eic AS a, p.eic AS b FROM j LEFT JOIN p u ON j.eic_g = u.eic LEFT JOIN p ON j.eic_p = p.eic)
SELECT count(a) AS matched_unit_eic, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS matched_plant_eic, count(*) FILTER (a IS NULL AND b IS NULL) AS unmatched FROM m""")
def register_match_statistics(spark, d):
    return rg.match_statistics(rg.match_registers(fx.view(spark, d, JRC_SQL), fx.view(spark, d, PPM_SQL)))


def _units(spark, d):
    return fx.view(spark, d, JRC_SQL).selectExpr(
        "eic_g AS unit_eic", "eic_p AS plant_eic", "name_g AS unit_name", "name_p AS plant_name", "type_g AS fuel_type", "country", "lat", "lon", "year_commissioned",
        "capacity_g AS unit_installed_capacity", "capacity_p AS plant_installed_capacity", "CASE WHEN type_g = 'Nuclear' THEN 'Nuclear' ELSE 'Steam Turbine' END AS technology",
        "cast(NULL AS string) AS fuel_type_code")


@query("register_by_country", f"""WITH j AS ({JRC_SQL}), p AS (SELECT eic_p, arg_max(country, {{'c': capacity_g, 'u': eic_g}}) AS country FROM j GROUP BY 1),
a AS (SELECT country, count(DISTINCT eic_g) AS n_units, sum(capacity_g) / 1000.0 AS unit_cap_gw FROM j GROUP BY 1), b AS (SELECT country, count(*) AS n_plants FROM p GROUP BY 1)
SELECT country, n_units, round(unit_cap_gw, 6) AS unit_cap_gw, coalesce(n_plants, 0) AS n_plants, round(unit_cap_gw / sum(unit_cap_gw) OVER () + 1e-9, 6) AS unit_cap_gw_share FROM a LEFT JOIN b USING (country)""")
def register_by_country(spark, d):
    c = rg.describe_register(_units(spark, d))["country"]
    return c.select("country", "n_units", F.round("unit_cap_gw", 6).alias("unit_cap_gw"), "n_plants", F.round(F.col("unit_cap_gw_share") + 1e-9, 6).alias("unit_cap_gw_share"))


@query("register_by_fuel_year", f"""WITH j AS ({JRC_SQL}) SELECT type_g AS fuel_type, year_commissioned, count(DISTINCT eic_g) AS n_units, round(sum(capacity_g) / 1000.0, 6) AS unit_cap_gw
FROM j WHERE year_commissioned IS NOT NULL GROUP BY 1, 2""")
def register_by_fuel_year(spark, d):
    return rg.describe_register(_units(spark, d))["fuel_year"].withColumn("unit_cap_gw", F.round("unit_cap_gw", 6))


@query("site_aggregates", f"""WITH j AS ({JRC_SQL}) SELECT concat('plant_eic:', eic_p) AS site, CASE WHEN type_g = 'Nuclear' THEN 'Nuclear' WHEN type_g = 'Solar' THEN 'Steam Turbine' ELSE 'Steam Turbine' END AS tech_symbol,
  type_g AS fuel_label, sum(capacity_g) AS capacity_mw, round(sum(lat * capacity_g) / sum(capacity_g) + 1e-9, 6) AS lat, round(sum(lon * capacity_g) / sum(capacity_g) + 1e-9, 6) AS lon, count(*) AS rows
FROM j WHERE lat BETWEEN 5 AND 45 AND lon BETWEEN -10 AND 40 AND capacity_g > 0 GROUP BY 1, 2, 3""")
def site_aggregates(spark, d):
    s, _ = rg.site_aggregates(_units(spark, d), (-10, 40, 5, 45))
    return s.select("site", "tech_symbol", "fuel_label", "capacity_mw", F.round(F.col("lat") + 1e-9, 6).alias("lat"), F.round(F.col("lon") + 1e-9, 6).alias("lon"), "rows")


@query("plant_capacity_series", f"""WITH m AS (SELECT plant_eic_norm AS p, unit_installed_capacity AS mw, make_timestamp(CAST(year_commissioned AS BIGINT), 1, 1, 0, 0, 0) AS t0,
  CASE WHEN year_decommissioned IS NOT NULL THEN make_timestamp(CAST(year_decommissioned AS BIGINT), 1, 1, 0, 0, 0) END AS t1 FROM ({PLANT_MAP_SQL})),
k AS (SELECT * FROM m WHERE t1 IS NULL OR t1 > t0), b AS (SELECT p, t0 AS t FROM k UNION SELECT p, t1 FROM k WHERE t1 IS NOT NULL),
l AS (SELECT b.p, b.t, coalesce(sum(k.mw), 0) AS mw FROM b LEFT JOIN k ON b.p = k.p AND k.t0 <= b.t AND (k.t1 IS NULL OR k.t1 > b.t) GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN lag(mw) OVER w = mw THEN 0 ELSE 1 END AS nw FROM l WINDOW w AS (PARTITION BY p ORDER BY t)),
z AS (SELECT p, t, mw FROM c WHERE nw = 1), e AS (SELECT *, lead(t) OVER (PARTITION BY p ORDER BY t) AS nx FROM z)
SELECT p AS plant_eic_norm, t AS valid_from, nx AS valid_to, mw FROM e WHERE mw > 0""")
def plant_capacity_series(spark, d):
    return cap.plant_capacity_series(_plant_map(spark, d))


@query("plant_identity", f"""WITH m AS ({PLANT_MAP_SQL}), n AS (SELECT plant_eic_norm, count(DISTINCT unit_eic_norm) AS c FROM m GROUP BY 1)
SELECT unit_eic AS eic_code, 'unit-eic' AS plant_mapping_match_kind, concat(country, '|', fuel_type, '|', lower(m.plant_eic_norm)) AS plant_id FROM m JOIN n ON m.plant_eic_norm = n.plant_eic_norm WHERE c > 1""")
def plant_identity(spark, d):
    pm = _plant_map(spark, d)
    u = pm.selectExpr("unit_eic AS eic_code", "unit_name", "country", "fuel_type AS plant_type", "'GENERATION' AS asset_type")
    return rg.attach_plants(u, pm).select("eic_code", "plant_mapping_match_kind", "plant_id")


@query("plant_required_units", f"""WITH m AS ({PLANT_MAP_SQL}) SELECT DISTINCT plant_eic_norm AS reported_eic_code, unit_eic AS eic_code FROM m""")
def plant_required_units(spark, d):
    pm = _plant_map(spark, d)
    u = pm.selectExpr("plant_eic_norm AS eic_code", "cast(NULL AS string) AS unit_name", "'' AS country", "'' AS plant_type", "'PRODUCTION' AS asset_type").distinct()
    return rg.plant_generation_units(rg.attach_plants(u, pm), pm).select("reported_eic_code", "eic_code")


@query("w_code_aliases", """WITH w AS (SELECT concat('U', cast(c_custkey AS varchar(20))) AS code, concat('U', cast(c_nationkey AS varchar(20))) AS parent FROM customer),
c AS (SELECT DISTINCT concat('U', cast(s_suppkey AS varchar(20))) AS k FROM supplier)
SELECT code AS alias, parent FROM w WHERE code <> parent AND code NOT IN (SELECT k FROM c) AND parent IN (SELECT k FROM c)""")
def w_code_aliases(spark, d):
    w = fx.view(spark, d, """SELECT concat('U', cast(c_custkey AS varchar(20))) AS eic_code, concat('U', cast(c_nationkey AS varchar(20))) AS eic_parent, 'Active' AS eic_status FROM customer""")
    return cap.w_aliases(w, fx.view(spark, d, "SELECT concat('U', cast(s_suppkey AS varchar(20))) AS unit_eic FROM supplier"))


@query("capacity_key_choice", """WITH u AS (SELECT concat('U', lpad(cast(s_suppkey AS varchar(20)), 5, '0')) AS unit_eic, s_suppkey FROM supplier), cap AS (SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS k, p_size FROM part)
SELECT unit_eic, CASE WHEN s_suppkey IN (SELECT k FROM cap WHERE p_size <= 5) THEN 'plant_map' ELSE 'eic' END AS key_kind FROM u WHERE s_suppkey IN (SELECT k FROM cap)""")
def capacity_key_choice(spark, d):
    keys = fx.view(spark, d, """SELECT CASE WHEN p_size <= 5 THEN 'plant_map' ELSE 'eic' END AS key_kind,
        concat('U', lpad(cast(p_partkey % (SELECT count(*) FROM supplier) AS varchar(20)), 5, '0')) AS key FROM part""")
    both = keys.unionByName(keys.select(F.lit("eic").alias("key_kind"), "key"))
    u = fx.units(spark, d).selectExpr("unit_eic", "false AS is_plant_level")
    return cap.choose_keys(u, both, allow_name=False).select("unit_eic", "key_kind")


# --- diagnosis --------------------------------------------------------------------------

def _diag(spark, d):
    key = (spark.sparkContext.applicationId, d, "diag")
    if key not in fx._built:
        segs = materialise(dg.add_segments(fx.compared(spark, d)))
        comp = materialise(val.compare_hours(segs, fx.gen(spark, d), **_TOL))
        fx._built[key] = (segs, comp, materialise(dg.violation_rows(comp)))
    return fx._built[key]


_SEV = """CASE WHEN av <= 1e-9 OR av / inst <= 0.01 THEN 'total_outage' WHEN (inst - av) / inst >= 0.75 THEN 'very_high_partial_outage' WHEN (inst - av) / inst >= 0.5 THEN 'high_partial_outage'
  WHEN (inst - av) / inst >= 0.2 THEN 'medium_partial_outage' ELSE 'low_partial_outage' END"""


@query("violations_by_severity", chain("panel", "gen") + _CMP + f"""SELECT {_SEV} AS outage_severity, CASE WHEN excess <= 5 THEN '0-5MW' WHEN excess <= 20 THEN '5-20MW' WHEN excess <= 100 THEN '20-100MW' ELSE '>100MW' END AS excess_generation_mw_bin,
  count(*) AS violation_hours, count(DISTINCT unit_eic) AS n_units, round(sum(excess) + 1e-9, 6) AS total_excess_generation_mwh, round(median(excess) + 1e-9, 6) AS median_excess_generation_mw FROM viol GROUP BY 1, 2""")
def violations_by_severity(spark, d):
    s = dg.summarize(_diag(spark, d)[2], ["outage_severity", "excess_generation_mw_bin"])
    return rounded(s.select("outage_severity", "excess_generation_mw_bin", "violation_hours", "n_units", "total_excess_generation_mwh", "median_excess_generation_mw"))


@query("violations_by_component", chain("panel", "gen") + _CMP + """SELECT ot AS outage_type_detail, CASE WHEN greatest(po, pm, fo, fm) <= 0 THEN lower(ot) || CASE WHEN rs = 'maintenance' THEN '_maintenance' ELSE '_other' END WHEN po = greatest(po, pm, fo, fm) THEN 'planned_other'
  WHEN pm = greatest(po, pm, fo, fm) THEN 'planned_maintenance' WHEN fo = greatest(po, pm, fo, fm) THEN 'forced_other' ELSE 'forced_maintenance' END AS outage_component, count(*) AS violation_hours FROM viol GROUP BY 1, 2""")
def violations_by_component(spark, d):
    return dg.summarize(_diag(spark, d)[2], ["outage_type_detail", "outage_component"]).select("outage_type_detail", "outage_component", "violation_hours")


@query("overlapping_series", chain("hrs") + """SELECT coalesce(p.unit_eic, q.unit_eic) AS eic_code, date_trunc('month', coalesce(p.h, q.h)) AS month, count(*) AS hours, sum(least(p.av, q.av)) AS available_mwh
FROM hrs p FULL JOIN (SELECT unit_eic, h + interval '5' hour AS h, inst - av / 2 AS av FROM hrs) q ON p.unit_eic = q.unit_eic AND p.h = q.h GROUP BY 1, 2""")
def overlapping_series(spark, d):
    """Two series of every unit whose intervals overlap with other bounds: the lowest value of each hour."""
    one = fx.panel(spark, d).select("eic_code", "unit_id", "seg_start", "seg_end", "installed_capacity", "avail_capacity")
    later = lambda c: F.col(c) + F.expr("INTERVAL 5 HOUR")
    two = one.withColumns({"seg_start": later("seg_start"), "seg_end": later("seg_end"), "avail_capacity": F.col("installed_capacity") - F.col("avail_capacity") / 2})
    s = tl.dedup_unit_hours(one.unionByName(two))
    h = runs.hours_col()
    return s.groupBy("eic_code", F.date_trunc("month", "seg_start").alias("month")).agg(F.sum(h).alias("hours"), F.sum(F.col("avail_capacity") * h).alias("available_mwh"))


# hours with a restriction, their segment (touching hours with the same report ids) and their place in it
_PLACED = """, rh AS (SELECT p.*, d.oid FROM panel p LEFT JOIN domids d ON p.unit_eic = d.unit_eic AND p.h = d.h WHERE p.av < p.inst),
rn AS (SELECT *, CASE WHEN lag(h) OVER w = h - interval '1' hour AND lag(oid) OVER w IS NOT DISTINCT FROM oid THEN 0 ELSE 1 END AS nw FROM rh WINDOW w AS (PARTITION BY unit_eic ORDER BY h)),
rs AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY unit_eic ORDER BY h) AS BIGINT) AS sq FROM rn),
sg AS (SELECT unit_eic, sq, min(h) AS g0, max(h) AS g1, count(*) AS gd FROM rs GROUP BY 1, 2),
vp AS (SELECT v.*, concat(v.country, '|', v.plant_type_code, '|', v.unit_eic, '|', rs.sq) AS segment_uid, gd,
  CASE WHEN gd = 1 THEN 'single_hour' WHEN v.h = g0 THEN 'start_hour' WHEN v.h = g1 THEN 'end_hour' WHEN date_diff('hour', g0, v.h) / (gd - 1.0) < 0.25 THEN 'early'
       WHEN date_diff('hour', g0, v.h) / (gd - 1.0) > 0.75 THEN 'late' ELSE 'middle' END AS pos
  FROM viol v JOIN rs ON v.unit_eic = rs.unit_eic AND v.h = rs.h JOIN sg ON sg.unit_eic = rs.unit_eic AND sg.sq = rs.sq)"""
_POSITIONS = sorted(dg.POSITIONS)


def _top(column: str, names: list[str]) -> str:
    """First of ``names`` with the highest count."""
    n = {x: f"count(*) FILTER (WHERE {column} = '{x}')" for x in names}
    return "CASE " + " ".join(f"WHEN {n[x]} = greatest({', '.join(n.values())}) THEN '{x}'" for x in names) + " END"


@query("segment_patterns", chain("panel", "gen", "domids") + _CMP + _PLACED + f""", q AS (SELECT segment_uid, count(*) AS violation_hours, any_value(gd) AS segment_duration_h, date_diff('hour', min(h), max(h)) + 1 AS span,
  {_top('pos', _POSITIONS)} AS dominant_segment_position, {_top('sev', sorted(dg.SEVERITIES))} AS dominant_outage_severity,
  count(*) FILTER (WHERE pos = 'single_hour') AS n1, count(*) FILTER (WHERE pos IN ('start_hour', 'early')) AS n2, count(*) FILTER (WHERE pos IN ('end_hour', 'late')) AS n3, count(*) FILTER (WHERE pos = 'middle') AS n4
  FROM (SELECT *, {_SEV} AS sev FROM vp) GROUP BY 1)
SELECT segment_uid, violation_hours, segment_duration_h, dominant_segment_position, dominant_outage_severity, CASE WHEN n1 = violation_hours THEN 'single_hour_segment'
  WHEN violation_hours / segment_duration_h >= 0.75 OR span / segment_duration_h >= 0.75 THEN 'spread_across_segment' WHEN n2 / violation_hours >= 0.6 THEN 'beginning_cluster'
  WHEN n3 / violation_hours >= 0.6 THEN 'end_cluster' WHEN n4 / violation_hours >= 0.6 THEN 'middle_cluster' ELSE 'mixed' END AS violation_pattern FROM q""")
def segment_patterns(spark, d):
    return dg.segment_summary(_diag(spark, d)[2]).select("segment_uid", "violation_hours", "segment_duration_h", "dominant_segment_position", "dominant_outage_severity", "violation_pattern")


@query("violations_by_position", chain("panel", "gen", "domids") + _CMP + _PLACED + """SELECT pos AS segment_position,
  CASE WHEN gd <= 1 THEN '1h' WHEN gd <= 6 THEN '2-6h' WHEN gd <= 24 THEN '7-24h' WHEN gd <= 168 THEN '1-7d' WHEN gd <= 672 THEN '1-4w' ELSE '>4w' END AS segment_duration_bin,
  count(*) AS violation_hours, count(DISTINCT unit_eic) AS n_units, count(DISTINCT segment_uid) AS n_segments, min(h) AS first_violation_hour, max(h) AS last_violation_hour,
  round(sum(excess) + 1e-9, 6) AS total_excess_generation_mwh, round(sum(excess - tol) + 1e-9, 6) AS total_excess_above_tolerance_mwh, round(avg(excess) + 1e-9, 6) AS mean_excess_generation_mw,
  round(median(excess) + 1e-9, 6) AS median_excess_generation_mw, round(max(excess) + 1e-9, 6) AS max_excess_generation_mw, round(avg(100.0 * excess / inst) + 1e-9, 6) AS mean_excess_generation_factor_pct,
  round(max(100.0 * excess / inst) + 1e-9, 6) AS max_excess_generation_factor_pct, round(avg(100.0 * used / inst) + 1e-9, 6) AS mean_generation_factor_pct, round(avg(100.0 * av / inst) + 1e-9, 6) AS mean_availability_factor_pct
  FROM vp GROUP BY 1, 2""")
def violations_by_position(spark, d):
    return rounded(dg.summarize(_diag(spark, d)[2], ["segment_position", "segment_duration_bin"]))


@query("diagnosis_units", chain("panel", "gen") + _CMP + """, a AS (SELECT unit_eic, count(*) AS n, median(av) AS m, sum(inst - av) AS u FROM panel WHERE av < inst GROUP BY 1),
o AS (SELECT unit_eic, count(*) AS n, sum(CASE WHEN used - av > tol THEN 1 ELSE 0 END) AS v FROM cmp GROUP BY 1)
SELECT a.unit_eic AS eic_code, a.n AS availability_report_hours, m AS median_available_capacity_mw, u AS total_unavailable_capacity_mwh, coalesce(o.n, 0) AS observed_generation_hours, CAST(coalesce(v, 0) AS BIGINT) AS violation_hours
FROM a LEFT JOIN o ON a.unit_eic = o.unit_eic""")
def diagnosis_units(spark, d):
    segs, comp, rows = _diag(spark, d)
    return dg.unit_summary(segs, comp, rows).select("eic_code", "availability_report_hours", "median_available_capacity_mw", "total_unavailable_capacity_mwh", "observed_generation_hours", "violation_hours")


@query("gap_hours", chain("ctx", "act") + """, c AS (SELECT DISTINCT unit_eic, mrid, h FROM ctx), a AS (SELECT DISTINCT unit_eic, mrid, h FROM act), b AS (SELECT unit_eic, mrid, min(h) AS h0, max(h) AS h1 FROM a GROUP BY 1, 2)
SELECT c.unit_eic AS eic_code, c.mrid AS outage_event_id, count(*) AS gap_hours FROM c JOIN b ON c.unit_eic = b.unit_eic AND c.mrid = b.mrid AND c.h > h0 AND c.h < h1
LEFT JOIN a ON c.unit_eic = a.unit_eic AND c.mrid = a.mrid AND c.h = a.h WHERE a.h IS NULL GROUP BY 1, 2""")
def gap_hours(spark, d):
    ids = ("dominant_outage_type", "type_effective", "dominant_outage_reason", "active_outage_event_ids", "active_deration_event_ids",
           "active_deration_gap_bridge_event_ids", "is_deration_gap_bridge")
    p = fx.panel(spark, d, ids).withColumn("cmp_installed", F.col("installed_capacity"))
    return dg.gap_intervals(p).groupBy("eic_code", "outage_event_id").agg(F.sum(runs.hours_col()).alias("gap_hours"))


@query("event_metadata", chain("work") + """SELECT unit_eic AS eic_code, mrid AS event_id, min(start_out) AS event_start_out, max(end_out) AS event_end_out, min(start_derate) AS event_first_deration_start, max(end_derate) AS event_last_deration_end,
  min(created_doc) AS event_first_publication_time, string_agg(DISTINCT CAST(version AS varchar), '|' ORDER BY CAST(version AS varchar)) AS event_versions FROM clean GROUP BY 1, 2""")
def event_metadata(spark, d):
    return dg.event_metadata(fx.clean(spark, d)).select("eic_code", "event_id", "event_start_out", "event_end_out", "event_first_deration_start", "event_last_deration_end",
                                                        "event_first_publication_time", "event_versions")


# --- comparison -------------------------------------------------------------------------

def _relabelled(spark, d):
    return fx.panel(spark, d).withColumn("outage_type", F.when(F.col("outage_reason") == "maintenance", "Planned").otherwise(F.col("outage_type")))


_SIDES = """, o AS (SELECT country, plant_type_code, strftime(h, '%Y-%m') AS month, inst - av AS mw, ot AS t0, CASE WHEN rs = 'maintenance' THEN 'Planned' ELSE ot END AS t1 FROM panel)"""


@query("panel_compare_monthly", chain("panel") + _SIDES + """SELECT country, plant_type_code, month, count(*) AS unit_hours_old, sum(mw) AS outage_mwh_old, sum(CASE WHEN t0 = 'Forced' THEN mw ELSE 0 END) AS forced_outage_mwh_old,
  sum(CASE WHEN t1 = 'Forced' THEN mw ELSE 0 END) AS forced_outage_mwh_new, sum(CASE WHEN t1 = 'Planned' THEN mw ELSE 0 END) - sum(CASE WHEN t0 = 'Planned' THEN mw ELSE 0 END) AS planned_outage_mwh_delta FROM o GROUP BY 1, 2, 3""")
def panel_compare_monthly(spark, d):
    m = ["unit_hours", *compare.MEASURES]
    c = compare.compare_sides(compare.monthly_side(fx.panel(spark, d)), compare.monthly_side(_relabelled(spark, d)), compare.KEYS, m)
    return c.select("country", "plant_type_code", "month", "unit_hours_old", "outage_mwh_old", "forced_outage_mwh_old", "forced_outage_mwh_new", "planned_outage_mwh_delta")


@query("label_change_energy", chain("panel") + _SIDES + """SELECT country, plant_type_code, month, sum(CASE WHEN coalesce(t0, '') <> coalesce(t1, '') THEN mw ELSE 0 END) AS changed_mwh FROM o WHERE mw > 0 GROUP BY 1, 2, 3""")
def label_change_energy(spark, d):
    return compare.label_changes(fx.panel(spark, d), _relabelled(spark, d)).select("country", "plant_type_code", "month", "changed_mwh")


_DATA = """SELECT n_name AS country, c_mktsegment AS plant_type, cast(year(o_orderdate) AS varchar(4)) AS period_key, 'orders' AS metric, avg(o_totalprice) AS dataset_value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"""
_REPORTED = """SELECT n_name AS country, c_mktsegment AS plant_type, 'orders' AS metric, 150000 + avg(c_acctbal) AS report_value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""


@query("kpi_corridor", f"""WITH a AS ({_DATA}), r AS ({_REPORTED}), g AS (SELECT country, plant_type, metric, count(DISTINCT period_key) AS n_years, min(dataset_value) AS mn, quantile_cont(dataset_value, 0.25) AS q1, median(dataset_value) AS md,
  quantile_cont(dataset_value, 0.75) AS q3, max(dataset_value) AS mx FROM a GROUP BY 1, 2, 3)
SELECT country, plant_type, n_years, round(mn + 1e-9, 4) AS annual_min, round(q1 + 1e-9, 4) AS annual_q25, round(md + 1e-9, 4) AS annual_median, round(q3 + 1e-9, 4) AS annual_q75, round(mx + 1e-9, 4) AS annual_max,
  report_value BETWEEN mn AND mx AS in_corridor, round(CASE WHEN report_value < mn THEN report_value - mn WHEN report_value > mx THEN report_value - mx ELSE 0 END + 1e-9, 4) AS diff_to_corridor FROM g JOIN r USING (country, plant_type, metric)""")
def kpi_corridor(spark, d):
    c = compare.annual_corridor(fx.view(spark, d, _DATA), fx.view(spark, d, _REPORTED), "published")
    return rounded(c.select("country", "plant_type", "n_years", "annual_min", "annual_q25", "annual_median", "annual_q75", "annual_max", "in_corridor", "diff_to_corridor"), 4)


_SOURCES = """SELECT n_name AS country, l_returnflag AS flag, l_linestatus AS source, l_extendedprice AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


@query("pairwise_sources", f"""WITH s AS ({_SOURCES}), p AS (SELECT country, flag, avg(CASE WHEN source = 'F' THEN value END) AS f, avg(CASE WHEN source = 'O' THEN value END) AS o FROM s GROUP BY 1, 2)
SELECT country, flag, round(f + 1e-9, 4) AS f_mean, round(o + 1e-9, 4) AS o_mean, round(abs(o - f) + 1e-9, 4) AS abs_diff FROM p WHERE f IS NOT NULL AND o IS NOT NULL""")
def pairwise_sources(spark, d):
    p = compare.pairwise(fx.view(spark, d, _SOURCES), "flag", "F", "O")
    return rounded(p.select("country", "flag", F.col("F").alias("f_mean"), F.col("O").alias("o_mean"), "abs_diff"), 4)


@query("source_agreement", f"""WITH s AS ({_SOURCES}), p AS (SELECT country, flag, avg(CASE WHEN source = 'F' THEN value END) AS f, avg(CASE WHEN source = 'O' THEN value END) AS o FROM s GROUP BY 1, 2), q AS (SELECT o - f AS df FROM p WHERE o IS NOT NULL AND f IS NOT NULL)
SELECT count(*) AS n, round(avg(df) + 1e-9, 4) AS mean_diff, round(median(df) + 1e-9, 4) AS median_diff, round(avg(df) - 1.96 * stddev_samp(df) + 1e-9, 4) AS lower_limit, round(avg(df) + 1.96 * stddev_samp(df) + 1e-9, 4) AS upper_limit FROM q""")
def source_agreement(spark, d):
    p = compare.pairwise(fx.view(spark, d, _SOURCES), "flag", "F", "O")
    return rounded(compare.agreement(p).select("n", "mean_diff", "median_diff", "lower_limit", "upper_limit"), 4)


@query("country_group_matrix", f"""WITH s AS ({_SOURCES}) SELECT country, round(avg(CASE WHEN flag = 'A' THEN value END) + 1e-9, 4) AS "A", round(avg(CASE WHEN flag = 'N' THEN value END) + 1e-9, 4) AS "N", round(avg(CASE WHEN flag = 'R' THEN value END) + 1e-9, 4) AS "R" FROM s GROUP BY 1""")
def country_group_matrix(spark, d):
    return rounded(compare.matrix(fx.view(spark, d, _SOURCES), "flag", ["A", "N", "R"]), 4)


@query("colour_limits", f"""WITH s AS ({_SOURCES}) SELECT round(quantile_cont(value, 0.02) + 1e-9, 4) AS p2, round(quantile_cont(value, 0.98) + 1e-9, 4) AS p98 FROM s""")
def colour_limits(spark, d):
    return rounded(compare.colour_limits(fx.view(spark, d, _SOURCES)), 4)


@query("category_counts", """SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) + 1e-9, 6) AS share FROM orders GROUP BY 1, 2""")
def category_counts(spark, d):
    fx.tables(spark, d)
    return rounded(compare.counts_by(spark.table("orders").selectExpr("o_orderstatus AS status", "o_orderpriority AS priority"), "status", "priority"))


_KPIS = """SELECT n_name AS country, l_returnflag AS plant_type, CASE WHEN l_linestatus = 'F' THEN 'published' ELSE 'own results' END AS source, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) AS q
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3"""


@query("reference_fallback", f"""WITH k AS ({_KPIS}), v AS (SELECT country, plant_type, source, unnest(['uFOR', 'uPOR', 'uTOF', 'wRR_so_h']) AS metric,
  unnest(CASE WHEN source = 'published' THEN [100 * d, q / 365 * 100, 100 * d + q / 365 * 100, 100 * d] ELSE [100 * d, 100 * t, 100 * (d + t), q / 24] END) AS value FROM k),
b AS (SELECT country, plant_type FROM k GROUP BY 1, 2 HAVING count(DISTINCT source) = 2)
SELECT v.country, v.plant_type, source, metric, round(value + 1e-9, 6) AS value FROM v JOIN b USING (country, plant_type)""")
def reference_fallback(spark, d):
    """The published side has no uFOR but a rate in percent, no planned rate but days, and no total,
    which is then the sum of both; our own side has fractions and hours."""
    k, pub = fx.view(spark, d, _KPIS), F.col("source") == "published"
    wide = k.select("country", "plant_type", "source", F.when(~pub, F.col("d")).alias("uFOR"), F.when(pub, 100 * F.col("d")).alias("Forced outage-rate"),
                    F.when(~pub, F.col("t")).alias("uPOR"), F.when(pub, F.col("q")).alias("planned outage days"), F.when(~pub, F.col("d") + F.col("t")).alias("uTOF"),
                    F.when(~pub, F.col("q")).alias("wRR_so_h"))
    rows = references.metric_rows(wide, "plant_type", "published", "own results", ["uFOR", "uPOR", "uTOF", "wRR_so_h"])
    return rounded(rows.select("country", "plant_type", "source", "metric", "value"))


@query("outage_days", """SELECT n_name AS country, cast(year(o_orderdate) AS varchar(4)) AS period_key, round(avg(o_totalprice / 1000000.0) * CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 366 ELSE 365 END + 1e-9, 6) AS "FOD"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, year(o_orderdate)""")
def outage_days(spark, d):
    k = fx.view(spark, d, """SELECT n_name AS country, cast(year(o_orderdate) AS varchar(4)) AS period_key, avg(o_totalprice / 1000000.0) AS wfof
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
    return rounded(compare.outage_days(k).select("country", "period_key", "FOD"))


# --- corrections fed back ---------------------------------------------------------------

@query("corrected_unit_tallies", chain("panel", "gen", "rep", "domids", "tal") + _SEG + _RECS + _MASK + """SELECT tal.unit_eic AS eic_code, """ + ", ".join(
    [f"CAST(sum(CASE WHEN mk.h IS NULL THEN {c} ELSE 0 END) AS BIGINT) AS {c}" for c in tl.FULL] + [f"round(sum(CASE WHEN mk.h IS NULL THEN {c} ELSE 0 END) + 1e-7, 4) AS {c}" for c in tl.PARTIAL])
    + ", count(mk.h) AS corrected_hours FROM tal LEFT JOIN mk ON tal.unit_eic = mk.unit_eic AND tal.h = mk.h GROUP BY 1")
def corrected_unit_tallies(spark, d):
    r, h = _recommended(spark, d)
    mask = materialise(inverse.correction_mask(h, r))
    t = tl.tally(inverse.apply_corrections(fx.labelled(spark, d), mask))
    hh = runs.hours_col()
    return rounded(t.groupBy("eic_code").agg(*[F.sum(F.col(c) * hh).alias(c) for c in (*tl.FULL, *tl.PARTIAL)], F.sum(F.when(F.col("inverse_correction_applied"), hh).otherwise(0)).alias("corrected_hours")))


_ = text
