"""Cleaning and version selection of outage reports (one row per document interval)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codes, text
from ..functions.maths import num
from ..functions.times import ceil_hour, floor_hour, ts
from ..session import materialise
from . import capacity as cap
from .rows import best_row, high_first, low_first, require

WINDOWS = ["start_out", "end_out", "start_derate", "end_derate"]
ID_COLUMNS = [
    "mrid", "original_mrid", "unit_eic", "unit_name", "version", "status", "old_version", "asset_type",
    "plant_type_code", "plant_type", "area", "area_code", "area_type", "country", "outage_type", "reason",
]


def active_current() -> Column:
    """Status is active and the row is not marked as an old version."""
    return (F.lower(F.trim(F.coalesce("status", F.lit("")))) == "active") & text.is_false_like("old_version")


def repair_document_times(df: DataFrame) -> DataFrame:
    """Publication never after the update, each fills the other; sort time = update."""
    created = F.when(F.col("created_doc") > F.col("update_time"), F.col("update_time")).otherwise(F.col("created_doc"))
    return (
        df.withColumn("created_doc", F.coalesce(created, "update_time"))
        .withColumn("update_time", F.coalesce("update_time", "created_doc"))
        .withColumn("document_sort_time", F.col("update_time"))
    )


def document_time_report(df: DataFrame) -> DataFrame:
    """Rows published after their own update, before repair."""
    late = (F.unix_micros("created_doc") - F.unix_micros("update_time")) / 1e6
    return df.filter(F.col("created_doc") > F.col("update_time")).select(
        *_ids(df), F.col("created_doc").alias("version_publication_time_before"), "update_time",
        late.alias("publication_after_update_seconds"))


def _ids(df: DataFrame) -> list[str]:
    return [c for c in ID_COLUMNS if c in df.columns]


def default_deration_window(df: DataFrame) -> DataFrame:
    return df.withColumn("start_derate", F.coalesce("start_derate", "start_out")).withColumn(
        "end_derate", F.coalesce("end_derate", "end_out"))


def _outside() -> Column:
    return F.coalesce(
        (F.col("start_derate") < F.col("start_out")) | (F.col("end_derate") > F.col("end_out")), F.lit(False))


def bound_deration(df: DataFrame, policy: str = "clip") -> DataFrame:
    """Deration window inside the outage window: clip | drop | ignore."""
    require(policy, ("clip", "drop", "ignore"), "policy")
    if policy == "drop":
        return df.filter(~_outside())
    if policy == "ignore":
        return df
    return df.withColumn("start_derate", F.greatest("start_derate", "start_out")).withColumn(
        "end_derate", F.least("end_derate", "end_out"))


def bounds_report(df: DataFrame, policy: str = "clip") -> DataFrame:
    return df.filter(_outside()).select(
        *_ids(df), F.lit(policy).alias("ts_bounds_policy"), "start_out", "end_out",
        F.col("start_derate").alias("start_derate_before"), F.col("end_derate").alias("end_derate_before"),
        F.greatest("start_derate", "start_out").alias("start_derate_after"),
        F.least("end_derate", "end_out").alias("end_derate_after"))


def within_horizon(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter((F.col("end_out") > ts(start)) & (F.col("start_out") < ts(end)))


def _clipped(start: str, end: str) -> dict[str, Column]:
    lo = lambda c: F.when(F.col(c).isNotNull(), F.greatest(c, ts(start)))
    hi = lambda c: F.when(F.col(c).isNotNull(), F.least(c, ts(end)))
    return {"start_out": lo("start_out"), "end_out": hi("end_out"),
            "start_derate": lo("start_derate"), "end_derate": hi("end_derate")}


def clip_horizon(df: DataFrame, start: str, end: str) -> DataFrame:
    """Keep reports touching [start, end); starts move up to start, ends down to end."""
    return within_horizon(df, start, end).withColumns(_clipped(start, end))


def _moved(start: str, end: str) -> Column:
    """The horizon changes a bound of the row."""
    after = _clipped(start, end)
    changed = F.lit(False)
    for c in WINDOWS:
        changed = changed | ~F.col(c).eqNullSafe(after[c])
    return changed


def horizon_report(df: DataFrame, start: str, end: str) -> DataFrame:
    after = _clipped(start, end)
    return within_horizon(df, start, end).filter(_moved(start, end)).select(
        *_ids(df), ts(start).alias("study_start"), ts(end).alias("study_end_exclusive"),
        *[F.col(c).alias(f"{c}_before") for c in WINDOWS], *[after[c].alias(f"{c}_after") for c in WINDOWS])


def inner_hours(df: DataFrame) -> DataFrame:
    """Only fully covered hours: starts round up, ends down, empty windows go."""
    return df.withColumns({
        "start_out": ceil_hour("start_out"), "end_out": floor_hour("end_out"),
        "start_derate": ceil_hour("start_derate"), "end_derate": floor_hour("end_derate"),
    }).filter((F.col("end_out") > F.col("start_out")) & (F.col("end_derate") > F.col("start_derate")))


#: Column by which ``by_document`` deals rows.
DOC = "_doc"


def by_document(df: DataFrame) -> DataFrame:
    """Rows dealt by their document id, with column ``DOC``: the id up to its first "__", which
    ``scope_mrids`` leaves as it is. What groups by ``DOC`` and more needs no further shuffle."""
    start = F.substring_index(F.trim(F.coalesce("mrid", F.lit(""))), "__", 1)
    return df.withColumn(DOC, F.rtrim(start, F.lit("_"))).repartition(DOC)


def _scoped(df: DataFrame) -> DataFrame:
    """``scope_mrids`` for rows that ``by_document`` has dealt."""
    original = F.trim(F.coalesce("mrid", F.lit("")))
    unit = F.upper(F.trim(F.coalesce("unit_eic", F.lit(""))))
    scope = F.when(unit != "", unit).otherwise(text.id_suffix("unit_name") if "unit_name" in df.columns else "UNKNOWN_UNIT")
    names = [c for c in df.columns if c != "original_mrid"]
    df = df.withColumn("original_mrid", original).withColumn("mrid_unit_scope", scope)
    of = Window.partitionBy(DOC, "original_mrid")
    df = df.withColumns({"_a": F.min("mrid_unit_scope").over(of), "_b": F.max("mrid_unit_scope").over(of)})
    df = df.withColumn("mrid_cross_unit_duplicate", (F.col("original_mrid") != "") & (F.col("_a") != F.col("_b")))
    return (
        df.withColumn("mrid", F.when(
            F.col("mrid_cross_unit_duplicate"),
            F.concat("original_mrid", F.lit("__"), text.id_suffix("mrid_unit_scope"))).otherwise(F.col("mrid")))
        .select("original_mrid", *names, "mrid_unit_scope", "mrid_cross_unit_duplicate")
    )


def scope_mrids(df: DataFrame, keep_dealt: bool = False) -> DataFrame:
    """Give a document id that occurs on several units one id per unit.

    "Several units" is ``min(unit) <> max(unit)`` over the id's rows. ``keep_dealt``: leave the
    column by which rows are dealt, for steps that group by document.
    """
    out = _scoped(by_document(df))
    return out if keep_dealt else out.drop(DOC)


EVENT_KEYS = ["asset_type", "mrid"]
INTERVAL_KEYS = [*EVENT_KEYS, "unit_eic", *WINDOWS]


def _version_order(tie: str) -> list[Column]:
    avail = F.col("avail_capacity")
    return [F.coalesce("version", F.lit(-1)), F.col("document_sort_time"), ~active_current(),
            *(low_first(avail) if tie == "lowest" else high_first(avail))]


def distinct_intervals(df: DataFrame, tie: str = "lowest") -> DataFrame:
    """One row per document interval: highest version, latest document, capacity rule."""
    return best_row(df, [*_dealt(df), *INTERVAL_KEYS], _version_order(tie))


def _dealt(df: DataFrame) -> list[str]:
    """The column that rows are dealt by; it follows from the id, so groups stay the same."""
    return [DOC] if DOC in df.columns else []


def current_records(
    df: DataFrame, status_policy: str = "active-filter-first",
    mode: str = "latest_version_intervals", tie: str = "lowest",
) -> DataFrame:
    """Current rows per document.

    single_record: one row of the highest version. latest_version_intervals: every
    distinct interval of the highest version, duplicates settled by document time
    (latest), then inactive before active, then the capacity rule. With latest-status
    the active filter runs after the choice, so a later cancellation removes the event.
    """
    require(status_policy, ("active-filter-first", "latest-status"), "status_policy")
    require(mode, ("single_record", "latest_version_intervals"), "mode")
    require(tie, ("lowest", "highest"), "tie")
    if status_policy == "active-filter-first":
        df = df.filter(active_current())
    order = _version_order(tie)
    if mode == "single_record":
        out = best_row(df, EVENT_KEYS, order)
    else:
        # An interval's best row carries the interval's highest version, so exact duplicates
        # shrink first; then intervals below the document's highest version drop out.
        rows = distinct_intervals(df, tie).withColumn("_v", F.coalesce("version", F.lit(-1)))
        top = F.max("_v").over(Window.partitionBy(*_dealt(df), *EVENT_KEYS))
        out = rows.withColumn("_top", top).filter(F.col("_v") == F.col("_top")).drop("_v", "_top")
    if status_policy == "latest-status":
        out = out.filter(active_current())
    return out


def mrid_duplicates(df: DataFrame) -> DataFrame:
    """Rows whose id is not unique or was shared between units."""
    many = df.groupBy("mrid").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("mrid", F.lit(True).alias("_m"))
    return (
        df.join(many, "mrid", "left")
        .filter(F.col("_m").isNotNull() | F.col("mrid_cross_unit_duplicate"))
        .drop("_m").withColumn("outage_reason", text.reason_class("reason"))
    )


def multi_interval_counts(df: DataFrame) -> DataFrame:
    """One row: documents with several current intervals, and their rows."""
    n = df.groupBy(*EVENT_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("multi_interval_mrids"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("multi_interval_rows"))


def _named_type(wanted: str) -> Column:
    return F.coalesce(text.clean("area_type"), F.lit(wanted.strip()))


def allowed_areas(df: DataFrame, wanted: str, y_areas: DataFrame | None = None) -> DataFrame:
    """Rows of known areas: the static list, plus directory codes with the wanted function.
    Rows that name no area type count as of the wanted one."""
    df = df.withColumn("area_type", _named_type(wanted)).filter(text.area_type_matches("area_type", wanted))
    static = F.col("area_code").isin(*codes.AREAS.values())
    if y_areas is None:
        return df.filter(static)
    want = wanted.strip().upper().replace("_", "/")
    fn = {"BZN": F.col("is_bidding_zone"), "CTA": F.col("is_control_area")}.get(
        want, F.col("is_bidding_zone") | F.col("is_control_area"))
    listed = y_areas.filter(fn).select(text.clean("eic_code").alias("area_code")).distinct().withColumn("_y", F.lit(True))
    return df.join(listed, "area_code", "left").filter(static | F.col("_y").isNotNull()).drop("_y")


def area_metadata(df: DataFrame, y_areas: DataFrame | None = None) -> DataFrame:
    """Area label and country with their fallbacks: list, map code, directory, label text."""
    if y_areas is not None:
        y = best_row(y_areas.select(
            text.clean("eic_code").alias("area_code"), "area_label", "area_country",
            F.col("area_status").alias("area_eic_status"),
            F.col("area_type_functions").alias("area_eic_type_functions")), ["area_code"], [])
        df = df.join(y, "area_code", "left")
    else:
        for c in ("area_label", "area_country", "area_eic_status", "area_eic_type_functions"):
            df = df.withColumn(c, F.lit(None).cast("string"))
    area = codes.area_label("area_code", "map_code", "area_label")
    known = lambda c: F.when(c.isin(*codes.AREAS), codes.country_of_label(c))
    return (
        df.withColumn("area", area)
        .withColumn("country", F.coalesce(
            known(F.col("area")), codes.country_of_label("map_code"),
            codes.country_of_label("area_country"), codes.country_of_label("area")))
        .drop("area_label", "area_country")
    )


def installed_from_lookup(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Installed capacity from the lookup only; available capacity never above it."""
    df = df.withColumn("_at", F.coalesce("start_derate", "start_out"))
    out = cap.attach_capacity(df, lookup, "_at", out="_ext").drop("_at")
    return (
        out.withColumn("installed_capacity_from_unit_table", F.col("_ext").isNotNull())
        .withColumn("avail_capacity", F.when(
            F.col("_ext").isNotNull() & (F.col("avail_capacity") > F.col("_ext")), F.col("_ext")
        ).otherwise(F.col("avail_capacity")))
        .withColumn("installed_capacity", F.col("_ext")).drop("_ext")
    )


@dataclass
class Prepared:
    """Lazy results of ``prepare_reports``."""

    clean: DataFrame
    mrid_dups: DataFrame
    document_time_report: DataFrame
    bounds_report: DataFrame
    horizon_report: DataFrame
    counters: DataFrame


def prepare_reports(
    raw: DataFrame, *, start: str, end: str, lookup: DataFrame | None = None,
    area_type: str = "BZN", asset_types: set[str] | None = None, y_areas: DataFrame | None = None,
    status_policy: str = "active-filter-first", tie: str = "lowest", bounds_policy: str = "clip",
    check_areas: bool = True,
) -> Prepared:
    """Raw conformed reports to clean, current, hour-aligned intervals inside [start, end)."""
    df = raw.withColumn("asset_type", F.upper(text.clean("asset_type")))
    if asset_types is not None:
        df = df.filter(F.col("asset_type").isin(*asset_types))
    typed = df
    if check_areas:
        df = allowed_areas(df, area_type, y_areas)
    if status_policy == "active-filter-first":
        df = df.filter(active_current())
    df = df.withColumns({"avail_capacity": num("avail_capacity"), "installed_capacity": num("installed_capacity")})
    if check_areas:
        df = area_metadata(df, y_areas)
    code = codes.plant_type_code("plant_type")
    label = F.coalesce(codes.plant_type_label("plant_type_code"), text.canonical_plant_type("plant_type"))
    if "plant_type_code" not in df.columns:
        df = df.withColumn("plant_type_code", code)
    df = df.withColumn("plant_type", label)
    time_report = document_time_report(df)
    before = df
    df = default_deration_window(repair_document_times(df))
    if lookup is not None:
        df = installed_from_lookup(df, lookup)
    df = df.filter(F.col("installed_capacity") > 0)
    # dealt by document once: scopes, versions and intervals are settled in place, so only the two ends are written
    scoped = _scoped(by_document(materialise(df)))
    current = current_records(scoped, status_policy, "latest_version_intervals", tie)
    # every document is down to one version here, so rounding can only create equal intervals
    clean = materialise(distinct_intervals(inner_hours(clip_horizon(bound_deration(current, bounds_policy), start, end)), tie).drop(DOC))
    scoped, chosen = scoped.drop(DOC), current.drop(DOC)
    bounded = bound_deration(chosen, bounds_policy)

    def counted(d: DataFrame, **which: Column) -> DataFrame:
        """All counters of one frame in one pass."""
        sums = d.agg(*[F.coalesce(F.sum(p.cast("long")), F.lit(0)).alias(n) for n, p in which.items()])
        return sums.selectExpr(f"stack({len(which)}, " + ", ".join(f"'{n}', {n}" for n in which) + ") as (counter, value)")

    every = F.lit(True)
    outside = current.withColumn("_outside", _outside())
    kept = ~F.col("_outside") if bounds_policy == "drop" else every
    in_study = (F.col("end_out") > ts(start)) & (F.col("start_out") < ts(end))
    current_rows = outside if bounds_policy == "drop" else bound_deration(outside, bounds_policy)
    counters = (
        counted(typed, rows_before_area_type_filter=every,
                rows_after_area_type_filter=text.area_type_matches(_named_type(area_type), area_type))
        .unionByName(counted(before, installed_capacity_missing_before_lookup=~F.coalesce(F.col("installed_capacity") > 0, F.lit(False)),
                             document_time_order_corrections=F.col("created_doc") > F.col("update_time")))
        .unionByName(counted(current_rows, ts_bounds_adjusted_rows=F.col("_outside"), horizon_clip_rows=kept & in_study & _moved(start, end)))
        .unionByName(counted(clean, clean_rows=every))
        .unionByName(multi_interval_counts(clean).selectExpr(
            "stack(2, 'multi_interval_mrids', multi_interval_mrids, 'multi_interval_rows', multi_interval_rows)"
            " as (counter, value)"))
    )
    return Prepared(clean, mrid_duplicates(scoped), time_report, bounds_report(chosen, bounds_policy),
                    horizon_report(bounded, start, end), counters)


def partition_listing(clean: DataFrame) -> DataFrame:
    """Units per (asset, area, plant type)."""
    return clean.select(text.asset_bucket("asset_type").alias("asset"), "area", "plant_type_code", "unit_eic").groupBy(
        "asset", "area", "plant_type_code").agg(F.count_distinct("unit_eic").alias("units"))


def select_partitions(
    df: DataFrame, keys: list[tuple[str, str]] | None = None, include: list[str] | None = None,
    exclude: list[str] | None = None, resume_from: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Filter by AREA:TYPE pairs, countries, or everything from a partition on (inclusive)."""
    if keys:
        cond = F.lit(False)
        for area, psr in keys:
            cond = cond | ((F.col("area") == area) & (F.col("plant_type_code") == psr))
        df = df.filter(cond)
    if include:
        df = df.filter(F.col("country").isin(*include))
    if exclude:
        df = df.filter(~F.coalesce(F.col("country").isin(*exclude), F.lit(False)))
    if resume_from:
        here = F.struct(text.asset_bucket("asset_type").alias("a"), F.col("area").alias("b"),
                        F.col("plant_type_code").alias("c"))
        df = df.filter(here >= F.struct(*[F.lit(v).alias(n) for v, n in zip(resume_from, "abc")]))
    return df
