"""Entity schemas and the tolerant ``conform`` projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .functions.maths import try_num
from .functions.text import clean
from .functions.times import parse_time

S, D, L, TS, B = "string", "double", "long", "timestamp", "boolean"

# Header spellings and column names of the data formats.
# name -> (type, accepted raw spellings, default)
OUTAGE_REPORT = {
    "mrid": (S, ["MRID", "InstanceCode"], None),
    "version": (L, ["Version"], 1),
    "status": (S, ["Status"], "Active"),
    "old_version": (S, ["OldVersion"], "false"),
    "outage_type": (S, ["Type"], None),
    "reason": (S, ["Reason"], None),
    "area_code": (S, ["AreaCode"], None),
    "area_type": (S, ["AreaTypeCode"], None),
    "map_code": (S, ["MapCode", "AreaMapCode"], None),
    "unit_eic": (S, ["PowerResourceEIC", "AssetCode"], None),
    "unit_name": (S, ["UnitName", "AssetName"], None),
    "asset_type": (S, ["AssetType"], None),
    "plant_type": (S, ["ProductionType"], None),
    "start_out": (TS, ["StartOutage", "StartOutage(UTC)"], None),
    "end_out": (TS, ["EndOutage", "EndOutage(UTC)"], None),
    "start_derate": (TS, ["StartTS", "StartTimeSeries(UTC)"], None),
    "end_derate": (TS, ["EndTS", "EndTimeSeries(UTC)"], None),
    "created_doc": (TS, ["VersionPublicationTimestamp(UTC)", "VersionPublicationTimestamp"], None),
    "update_time": (TS, ["UpdateTime(UTC)", "UpdateTime"], None),
    "avail_capacity": (D, ["AvailableCapacity", "AvailableCapacity[MW]"], None),
    "installed_capacity": (D, ["InstalledCapacity"], None),
}

UNIT_CAPACITY = {
    "unit_eic": (S, ["ProductionUnitCode"], None),
    "unit_name": (S, ["ProductionUnitName"], None),
    "area_map_code": (S, ["AreaMapCode"], None),
    "plant_type": (S, ["ProductionType"], None),
    "status": (S, ["Status"], None),
    "valid_from": (TS, ["ValidFrom"], "1900-01-01 00:00:00"),
    "valid_to": (TS, ["ValidTo"], None),
    "unit_installed_capacity": (D, ["InstalledCapacity(MW)", "InstalledCapacity[MW]"], None),
    "update_time": (TS, ["UpdateTime(UTC)"], None),
}

UNIT_GENERATION = {
    "timestamp": (TS, ["DateTime(UTC)", "DateTime (UTC)"], None),
    "eic_code": (S, ["GenerationUnitCode"], None),
    "area_code": (S, ["AreaCode"], None),
    "actual_generation_mw": (D, ["ActualGenerationOutput[MW]", "ActualGenerationOutput(MW)"], None),
    "actual_consumption_mw": (D, ["ActualConsumption[MW]", "ActualConsumption(MW)"], None),
}

EIC_W = {
    "eic_code": (S, ["EicCode"], None),
    "eic_display_name": (S, ["EicDisplayName"], None),
    "eic_long_name": (S, ["EicLongName"], None),
    "eic_parent": (S, ["EicParent"], None),
    "eic_status": (S, ["EicStatus"], None),
    "eic_type_functions": (S, ["EicTypeFunctionList"], None),
    "eic_country": (S, ["MarketParticipantIsoCountryCode"], None),
}

EIC_Y = {
    "eic_code": (S, ["EicCode"], None),
    "area_label": (S, ["EicDisplayName"], None),
    "area_long_name": (S, ["EicLongName"], None),
    "area_parent": (S, ["EicParent"], None),
    "area_status": (S, ["EicStatus"], None),
    "area_type_functions": (S, ["EicTypeFunctionList"], None),
    "area_country": (S, ["MarketParticipantIsoCountryCode"], None),
}

_MAP_TEXT = [
    "source_table", "source_id", "unit_eic", "unit_eic_is_synthetic", "unit_eic_source", "plant_eic",
    "unit_name", "plant_name", "country", "fuel_type", "fuel_type_code", "technology", "status",
    "unit_eic_norm", "plant_eic_norm", "source_id_norm", "name_key", "ppm_match_method", "ppm_id",
    "ppm_name", "ppm_date_in", "ppm_date_out", "ppm_eic", "duplicate_status", "duplicate_reason", "set",
]
_MAP_NUMBERS = [
    "unit_installed_capacity", "plant_installed_capacity", "ppm_capacity", "year_commissioned",
    "year_decommissioned", "ppm_match_score", "lat", "lon",
]
PLANT_MAP = {c: (S, [c], None) for c in _MAP_TEXT} | {c: (D, [c], None) for c in _MAP_NUMBERS}

JRC_REGISTER = {
    **{c: (S, [c], None) for c in
       ["eic_g", "eic_p", "name_g", "name_p", "type_g", "country", "NUTS2", "status_g"]},
    **{c: (D, [c], None) for c in
       ["capacity_g", "capacity_p", "lat", "lon", "year_commissioned", "year_decommissioned"]},
}

PPM_REGISTER = {
    "ppm_id": (S, ["Index", "id"], None),
    "ppm_eic": (S, ["EIC"], None),
    "ppm_name": (S, ["Name"], None),
    "ppm_capacity": (D, ["Capacity"], None),
    "technology": (S, ["Technology"], None),
    "set": (S, ["Set"], None),
    "bus": (S, ["Bus"], None),
    "lat": (D, ["lat"], None),
    "lon": (D, ["lon"], None),
    "date_in": (S, ["DateIn"], None),
    "date_out": (S, ["DateOut"], None),
}

# Columns of the hourly panel, in export order.
PANEL_COLUMNS = [
    "timestamp", "eic_code", "unit_name", "country", "area", "area_code", "area_type", "asset_type",
    "plant_type", "plant_type_code", "installed_capacity", "avail_capacity", "relative_avail_capacity",
    "state", "cluster_id", "cluster_start", "cluster_end_excl", "cluster_duration_h", "cluster_rule",
    "outage_id", "outage_type", "outage_reason", "dominant_outage_id", "dominant_outage_type",
    "dominant_outage_reason", "dominant_reason_inferred", "type_observed", "type_effective",
    "type_warning", "active_event_ids", "active_outage_event_ids", "active_deration_event_ids",
    "active_deration_gap_bridge_event_ids", "is_deration_gap_bridge", "baseline_context_event_ids",
    "baseline_event_ids", "dominant_event_ids", "reactive_event_ids", "suppressed_event_ids",
    "scheduled_loss_mw", "forced_increment_mw", "total_derate_mw", "derate_mw_planned_other",
    "derate_mw_planned_maintenance", "derate_mw_forced_other", "derate_mw_forced_maintenance",
]


def conform(df: DataFrame, spec: dict, keep: list[str] | None = None) -> DataFrame:
    """Project raw columns of any accepted spelling onto the entity's names and types.

    The first non-blank spelling wins; absent columns become their default. A column
    that already carries the target name is accepted too. Unparsable values are NULL.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name, (typ, raws, default) in spec.items():
        present = [c for c in dict.fromkeys([*raws, name]) if c in have]
        if not present:
            out.append(F.lit(default).cast(typ).alias(name))
            continue
        vals = []
        for c in present:
            q = F.col(f"`{c}`")
            if typ == TS:
                stamp = isinstance(have[c], (T.TimestampType, T.TimestampNTZType))
                vals.append(q.cast("timestamp") if stamp else parse_time(q))
            elif typ == D:
                vals.append(try_num(c))
            elif typ == L:
                vals.append(try_num(c).cast("long"))
            else:
                vals.append(clean(q))
        out.append(F.coalesce(*vals).cast(typ).alias(name))
    return df.select(*out, *[F.col(f"`{c}`") for c in (keep or [])])
