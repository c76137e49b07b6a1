"""Plant registers: matching, plant identity, descriptive tables, site aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays, codes, text
from ..functions.maths import nz, ratio, try_num
from .rows import best_row, require

# Fixed values.
EXCLUDED_FUELS = ["hydro", "hydro pumped storage", "hydro run-of-river and poundage", "hydro water reservoir", "marine", "solar",
                  "wind onshore", "wind offshore"]


def year_of(name: str) -> Column:
    """Year from a number or a date text."""
    n = try_num(name)
    return F.coalesce(F.floor(n).cast("double"), F.year(F.expr(f"try_to_timestamp(cast(`{name}` as string))")).cast("double"))


def explode_eic_sets(ppm: DataFrame, column: str = "ppm_eic", capacity: str = "ppm_capacity") -> DataFrame:
    """One row per identifier of a set written as text; capacity is split equally."""
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit("[A-Za-z0-9-]+"), F.lit(0))),
                      lambda t: ~F.upper(t).isin("NAN", "NULL"))
    d = ppm.filter(F.coalesce(F.trim(column), F.lit("")) != "").withColumn("_ids", tokens)
    return d.withColumn(capacity, F.when(F.size("_ids") > 0, F.col(capacity) / F.size("_ids")).otherwise(F.col(capacity))).withColumn(
        "eic", F.explode("_ids")).drop("_ids", column)


def most_complete(ppm: DataFrame) -> DataFrame:
    """One row per normalised identifier: the one with most attributes filled."""
    cols = [c for c in ("technology", "set", "bus", "lat", "lon", "date_in", "date_out") if c in ppm.columns]
    filled = F.lit(0)
    for c in cols:
        filled = filled + F.coalesce(F.col(c).cast("string") != "", F.lit(False)).cast("int")
    d = ppm.withColumn("eic_norm", text.eic_norm("eic")).filter(F.col("eic_norm") != "")
    return best_row(d, ["eic_norm"], [filled])


def integrate_registers(jrc: DataFrame, ppm: DataFrame, country_codes: dict[str, str] | None = None, lifetime: int = 45) -> DataFrame:
    """Matched registers without non-thermal fuels, rows without unit code and rows without any
    decommissioning year (known or commissioning + lifetime)."""
    return only_kept(match_registers(jrc, ppm, lifetime), country_codes)


def match_registers(jrc: DataFrame, ppm: DataFrame, lifetime: int = 45) -> DataFrame:
    """Unit register enriched by the second one: match on the unit code, else the plant code.
    Unit matches win column by column; every row of the first register stays."""
    cols = ["technology", "set", "bus", "lat", "lon", "date_in", "date_out"]
    p = most_complete(explode_eic_sets(ppm)).select("eic_norm", "eic", *cols)
    side = lambda tag: p.select(F.col("eic_norm").alias(f"_{tag}"), *[F.col(c).alias(f"{tag}_{c}") for c in ("eic", *cols)])
    j = jrc.withColumn("_gn", F.when(text.eic_norm("eic_g") != "", text.eic_norm("eic_g"))).withColumn(
        "_pn", F.when(text.eic_norm("eic_p") != "", text.eic_norm("eic_p")))
    j = j.join(side("u"), F.col("_gn") == F.col("_u"), "left").join(side("p"), F.col("_pn") == F.col("_p"), "left")
    pick = lambda c: F.coalesce(f"u_{c}", f"p_{c}")
    j = j.withColumn("eic_match_source", F.when(F.col("u_eic").isNotNull(), "unit_eic").when(F.col("p_eic").isNotNull(), "plant_eic"))
    j = j.withColumns({"technology": pick("technology"), "set": pick("set"), "bus": pick("bus"), "_in": pick("date_in"), "_out": pick("date_out"),
                       "lat": F.coalesce("lat", pick("lat")), "lon": F.coalesce("lon", pick("lon"))})
    j = j.withColumn("year_commissioned", F.coalesce("year_commissioned", year_of("_in"))).withColumn(
        "year_decommissioned", F.coalesce("year_decommissioned", year_of("_out")))
    return j.withColumn("year_decommissioned", F.coalesce("year_decommissioned", F.col("year_commissioned") + lifetime))


def only_kept(j: DataFrame, country_codes: dict[str, str] | None = None) -> DataFrame:
    code = F.upper(F.trim("type_g"))
    j = j.filter(~F.coalesce(F.lower(F.trim("type_g")).isin(*EXCLUDED_FUELS), F.lit(False)))
    j = j.filter(F.col("eic_g").isNotNull() & F.col("year_decommissioned").isNotNull())
    by_code = F.when(code.rlike("^[AB][0-9]{2}$"), code)
    known = F.when(codes.plant_type_code("type_g") != "Unknown", codes.plant_type_code("type_g"))
    country = codes.lookup(country_codes, F.trim("country")) if country_codes else F.trim("country")
    return j.select(
        F.col("eic_g").alias("unit_eic"), F.col("eic_p").alias("plant_eic"), F.col("name_g").alias("unit_name"), F.col("name_p").alias("plant_name"),
        F.col("type_g").alias("fuel_type"), F.coalesce(by_code, known).alias("fuel_type_code"),
        F.col("capacity_g").alias("unit_installed_capacity"), F.col("capacity_p").alias("plant_installed_capacity"), country.alias("country"),
        "lat", "lon", F.col("NUTS2").alias("nuts2"), "technology", "set", "bus", "year_commissioned", "year_decommissioned", "eic_match_source")


def match_statistics(joined: DataFrame) -> DataFrame:
    """Counts over all rows of ``match_registers``, before any filter."""
    return joined.agg(F.count_if(F.col("eic_match_source") == "unit_eic").alias("matched_unit_eic"),
                      F.count_if(F.col("eic_match_source") == "plant_eic").alias("matched_plant_eic"),
                      F.count_if(F.col("eic_match_source").isNull()).alias("unmatched"))


# --- plant identity ---------------------------------------------------------------------


def name_stem(c) -> Column:
    """Plant name without trailing unit words, numbers, roman numerals and a single letter."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text.col(c).cast("string"), F.lit(""))), "[^0-9a-z]+", " "))
    s = F.trim(F.regexp_replace(t, r"(?:(?:^| )(?:unit|block|gruppe|group|bloc|tranche|[0-9]+|[ivx]+))+$", ""))
    s = F.when(s.rlike(r"(^| )(st|saint) [a-z]$"), s).otherwise(F.regexp_replace(s, r"(?<=[^ ]) [a-z]$", ""))
    return F.when(s != "", s).otherwise(t)


def first_text(c: str, order: Column) -> Column:
    """Non-blank value of the row with the smallest order key."""
    v = text.clean(c)
    return F.min_by(v, F.when(v.isNotNull(), order))


def plant_lookup(pm: DataFrame) -> DataFrame:
    """Plant-level view of the plant map with unit counts per plant and per second id."""
    d = pm.filter(text.clean("plant_eic_norm").isNotNull())
    o = F.struct(F.coalesce("unit_eic_norm", F.lit("")), F.coalesce("unit_name", F.lit("")))
    g = d.groupBy("plant_eic_norm").agg(
        first_text("plant_eic", o).alias("plant_eic"), first_text("plant_name", o).alias("plant_name"), first_text("ppm_id", o).alias("ppm_id"),
        first_text("ppm_name", o).alias("ppm_name"), F.count_distinct(text.clean("unit_eic_norm")).alias("plant_eic_unit_count"))
    n = d.filter(text.clean("ppm_id").isNotNull()).groupBy("ppm_id").agg(F.count_distinct(text.clean("unit_eic_norm")).alias("ppm_id_unit_count"))
    g = g.join(n, "ppm_id", "left")
    return g.withColumn("plant_name_stem", text.first_present(name_stem("plant_name"), name_stem("ppm_name")))


def attach_plants(units: DataFrame, pm: DataFrame, id_source: str = "auto", match_mode: str = "auto") -> DataFrame:
    """Plant identity of reported units.

    A reported code is matched as unit and as plant; plant-level reports prefer the plant
    (auto). The plant id is the plant code when matched directly or shared by several
    units, else the second register's id when shared, else the name stem.
    """
    require(id_source, ("auto", "plant-eic", "plant-name-stem", "ppm-id"), "id_source")
    require(match_mode, ("auto", "unit-first", "plant-first"), "match_mode")
    lk = plant_lookup(pm)
    counts = lk.select(F.col("plant_eic_norm").alias("_cp"), "plant_eic_unit_count", "ppm_id_unit_count")
    u = best_row(pm.filter(text.clean("unit_eic_norm").isNotNull()), ["unit_eic_norm"], []).join(
        counts, F.col("plant_eic_norm") == F.col("_cp"), "left").select(
        F.col("unit_eic_norm").alias("u_norm"), F.col("unit_eic").alias("u_unit"), F.col("plant_eic_norm").alias("u_plant"), F.col("ppm_id").alias("u_ppm"),
        name_stem("plant_name").alias("u_stem"), F.col("plant_eic_unit_count").alias("u_n"), F.col("ppm_id_unit_count").alias("u_m"))
    p = lk.select(F.col("plant_eic_norm").alias("p_plant"), F.col("ppm_id").alias("p_ppm"), F.col("plant_name_stem").alias("p_stem"),
                  F.col("plant_eic_unit_count").alias("p_n"), F.col("ppm_id_unit_count").alias("p_m"))
    d = units.withColumn("_n", text.eic_norm("eic_code"))
    d = d.join(u, F.col("_n") == F.col("u_norm"), "left").join(p, F.col("_n") == F.col("p_plant"), "left")
    has_u, has_p = F.col("u_norm").isNotNull(), F.col("p_plant").isNotNull()
    first = {"plant-first": F.lit(True), "unit-first": F.lit(False)}.get(
        match_mode, F.upper(F.trim(F.coalesce("asset_type", F.lit("")))) == "PRODUCTION")
    use_p = has_p & (first | ~has_u)
    pick = lambda a: F.when(use_p, F.col(f"p_{a}")).otherwise(F.col(f"u_{a}"))
    d = d.withColumns({"plant_map_plant_eic_norm": pick("plant"), "plant_map_ppm_id": pick("ppm"), "_stem": pick("stem"), "_pn": pick("n"), "_pm": pick("m"),
                       "plant_map_unit_eic": F.when(has_u & ~use_p, F.col("u_unit")),
                       "plant_mapping_match_kind": F.when(use_p, "plant-eic").when(has_u, "unit-eic").otherwise("fallback")})
    stem = text.first_present("_stem", name_stem("unit_name"), "eic_code")
    pe, pid = text.clean("plant_map_plant_eic_norm"), text.clean("plant_map_ppm_id")
    by_pe = pe.isNotNull() & ((F.col("plant_mapping_match_kind") == "plant-eic") | F.coalesce(F.col("_pn") > 1, F.lit(False)))
    by_id = pid.isNotNull() & F.coalesce(F.col("_pm") > 1, F.lit(False))
    if id_source == "plant-eic":
        chosen, source = F.coalesce(pe, stem), F.lit("plant-eic")
    elif id_source == "ppm-id":
        chosen, source = F.coalesce(pid, stem), F.lit("ppm-id")
    elif id_source == "plant-name-stem":
        chosen, source = stem, F.lit("plant-name-stem")
    else:
        chosen = F.when(by_pe, pe).when(by_id, pid).otherwise(stem)
        source = F.when(by_pe, "plant-eic").when(by_id, "ppm-id").otherwise("plant-name-stem")
    key = F.trim(F.regexp_replace(F.lower(chosen), "[^0-9a-z]+", " "))
    d = d.withColumn("plant_id", F.concat_ws("|", F.coalesce("country", F.lit("")), F.coalesce("plant_type", F.lit("")),
                                             F.when(key != "", key).otherwise(F.col("eic_code"))))
    d = d.withColumn("plant_name", F.initcap(stem)).withColumn("plant_mapping_source", source)
    return d.drop("_n", "u_norm", "u_unit", "u_plant", "u_ppm", "u_stem", "u_n", "u_m", "p_plant", "p_ppm", "p_stem", "p_n", "p_m", "_stem", "_pn", "_pm")


def plant_generation_units(attached: DataFrame, pm: DataFrame) -> DataFrame:
    """(reported code, plant_id, generating unit): a plant-level report expands to its units."""
    base = attached.select(F.col("eic_code").alias("reported_eic_code"), "plant_id", "plant_mapping_match_kind", "plant_map_unit_eic", "plant_map_plant_eic_norm").distinct()
    own = base.filter("plant_mapping_match_kind <> 'plant-eic'").select(
        "reported_eic_code", "plant_id", text.first_present("plant_map_unit_eic", "reported_eic_code").alias("eic_code"))
    members = pm.filter(text.clean("plant_eic_norm").isNotNull()).select(
        F.col("plant_eic_norm").alias("_p"), text.first_present("unit_eic", "unit_eic_norm").alias("_u")).filter("_u IS NOT NULL").distinct()
    whole = base.filter("plant_mapping_match_kind = 'plant-eic'").join(members, F.col("plant_map_plant_eic_norm") == F.col("_p"), "left").select(
        "reported_eic_code", "plant_id", F.coalesce("_u", "reported_eic_code").alias("eic_code"))
    return own.unionByName(whole).distinct()


def required_hours(hours: DataFrame, unit_lookup: DataFrame) -> DataFrame:
    """Unit-hours needed for the reported hours after expansion to generating units."""
    lk = unit_lookup.select("reported_eic_code", F.col("eic_code").alias("_u"))
    d = hours.select("timestamp", F.col("eic_code").alias("reported_eic_code")).join(lk, "reported_eic_code", "left")
    return d.select("timestamp", text.first_present("_u", "reported_eic_code").alias("eic_code")).distinct()


def to_plant_panel(panel: DataFrame, attached: DataFrame) -> DataFrame:
    """Sum a panel per plant and interval; names and labels are joined as sorted sets.

    ``panel`` rows of one plant must share interval bounds (hourly rows do).
    """
    ids = attached.select("eic_code", "plant_id", F.col("plant_name").alias("_pname")).distinct()
    d = panel.join(ids, "eic_code")
    text_cols = [c for c in ("unit_name", "outage_id", "state", "outage_type", "outage_reason") if c in d.columns]
    return d.groupBy("seg_start", "seg_end", F.col("plant_id").alias("eic_code"), "country", "plant_type").agg(
        F.min("_pname").alias("plant_name"), F.count_distinct("eic_code").alias("n_reported_units"),
        *[F.sum(c).alias(c) for c in ("installed_capacity", "avail_capacity", "cmp_installed", "cmp_available") if c in d.columns],
        *[arrays.text_set(c, ";").alias(c) for c in text_cols])


# --- descriptive tables -----------------------------------------------------------------


def plant_key(df: DataFrame) -> Column:
    named = F.concat_ws("|", F.trim("country"), F.lower(F.trim(F.coalesce("plant_name", "unit_name"))))
    return text.first_present(*[c for c in ("plant_eic_norm", "plant_eic", "ppm_id", "source_id_norm", "source_id") if c in df.columns], named)


def plants_of(units: DataFrame) -> DataFrame:
    """Plants from units; attributes of the largest unit."""
    o = F.struct(F.coalesce("unit_installed_capacity", F.lit(-1.0)), "unit_eic")
    return units.withColumn("plant_key", plant_key(units)).groupBy("plant_key").agg(
        F.max_by("country", o).alias("country"), F.max_by("fuel_type", o).alias("fuel_type"), F.max_by("technology", o).alias("technology"),
        F.max("plant_installed_capacity").alias("plant_cap_mw"), F.sum("unit_installed_capacity").alias("unit_cap_sum_mw"),
        F.count_distinct("unit_eic").alias("n_units"))


def describe_register(units: DataFrame) -> dict[str, DataFrame]:
    """Units, plants, capacity and shares by country, fuel, technology and year."""
    plants = plants_of(units)
    gw = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / 1000.0

    def both(k: str) -> DataFrame:
        a = units.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count_distinct("unit_eic").alias("n_units"), gw("unit_installed_capacity").alias("unit_cap_gw"))
        b = plants.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n_plants"), gw("plant_cap_mw").alias("plant_cap_gw"))
        return a.join(b, k, "full").fillna(0)

    every = Window.partitionBy()  # one row per country
    country = both("country").withColumn("unit_cap_gw_share", ratio(F.col("unit_cap_gw"), F.sum("unit_cap_gw").over(every))).withColumn(
        "plant_cap_gw_share", ratio(F.col("plant_cap_gw"), F.sum("plant_cap_gw").over(every)))
    flat = lambda *k: units.filter(" AND ".join(f"{c} IS NOT NULL" for c in k)).groupBy(*k).agg(
        F.count_distinct("unit_eic").alias("n_units"), gw("unit_installed_capacity").alias("unit_cap_gw"))
    return {"country": country, "fuel": both("fuel_type"), "technology": both("technology"), "fuel_country": flat("country", "fuel_type"),
            "technology_country": flat("country", "technology"), "fuel_year": flat("fuel_type", "year_commissioned"),
            "technology_year": flat("technology", "year_commissioned")}


def fuel_code() -> Column:
    f, t = F.lower(text.squash("fuel_type")), F.lower(text.squash("technology"))
    code = F.upper(text.squash("fuel_type_code"))
    battery = f.rlike("battery|bess") | t.rlike("battery|bess")
    return (
        F.when(code.rlike("^[AB][0-9]{2}$"), code).when(battery, "B99")
        .when(f.contains("hydro") | t.isin("hydro", "run-of-river", "reservoir", "pumped storage"), "B11").otherwise("UNKNOWN")
    )


def technology_symbol(code: Column) -> Column:
    f, t = F.lower(text.squash("fuel_type")), F.lower(text.squash("technology"))
    return (
        F.when((code == "B99") | f.rlike("battery|bess") | t.rlike("battery|bess"), "BESS")
        .when(code.isin("B10", "B11", "B12") | f.contains("hydro") | t.isin("hydro", "run-of-river", "reservoir", "pumped storage"), "Hydro")
        .when((code == "B14") | (t == "nuclear"), "Nuclear").when(t == "ccgt", "CCGT").when(t == "ocgt", "OCGT")
        .when(t.contains("steam turbine"), "Steam Turbine").when(code.isin("B18", "B19") | t.isin("offshore", "onshore"), "Wind")
        .when((code == "B16") | (t == "pv"), "Solar").otherwise("Other")
    )


def site_key(df: DataFrame) -> Column:
    known = [F.when(~F.lower(text.squash(c)).isin("", "nan", "none"), F.concat(F.lit(f"{c}:"), text.squash(c)))
             for c in ("plant_eic_norm", "plant_eic", "ppm_id", "raw_project_id", "source_id_norm") if c in df.columns]
    place = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.3f", c))
    name = text.compact_name_key(text.first_present("plant_name", "unit_name"))
    return F.coalesce(*known, F.concat(F.lit("site:"), text.squash("country"), F.lit(":"), name, F.lit(":"), place("lat"), F.lit(":"), place("lon")))


def site_aggregates(units: DataFrame, extent: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Capacity-weighted sites inside the extent, and coverage per fuel."""
    x0, x1, y0, y1 = extent
    d = units.withColumn("capacity_mw", F.coalesce("unit_installed_capacity", "plant_installed_capacity")).withColumn("fuel_code", fuel_code())
    d = d.withColumn("fuel_label", F.coalesce(codes.plant_type_label("fuel_code"), text.squash("fuel_type"))).withColumn("tech_symbol", technology_symbol(F.col("fuel_code")))
    d = d.withColumn("site", site_key(d)).withColumn("on_map", F.coalesce(
        F.col("lat").between(y0, y1) & F.col("lon").between(x0, x1) & (F.col("capacity_mw") > 0), F.lit(False)))
    c = F.col("capacity_mw")
    sites = d.filter("on_map").groupBy("site", "fuel_code", "fuel_label", "tech_symbol").agg(
        F.sum(c).alias("capacity_mw"), ratio(F.sum(F.col("lat") * c), F.sum(c)).alias("lat"), ratio(F.sum(F.col("lon") * c), F.sum(c)).alias("lon"),
        F.count(F.lit(1)).alias("rows"), arrays.text_set("country", ";").alias("country"), F.min(F.coalesce("plant_name", "unit_name")).alias("example_plant"))
    summary = d.groupBy("fuel_code", "fuel_label").agg(F.count(F.lit(1)).alias("input_rows"), F.count_if("on_map").alias("rows_with_valid_map"),
                                                       F.sum(nz("capacity_mw")).alias("capacity_mw"))
    return sites, summary


def unit_metadata(plant_map: DataFrame, capacity: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Country, type and name per unit code: plant map, then capacity table, then alias parent."""
    a = plant_map.select(text.clean("unit_eic").alias("eic_code"), "country", text.first_present("fuel_type", "fuel_type_code").alias("plant_type"),
                         text.first_present("unit_name", "plant_name", "ppm_name").alias("unit_name"), F.lit(3).alias("p"))
    b = capacity.select(F.col("unit_eic").alias("eic_code"), "country", "plant_type", "unit_name", F.lit(2).alias("p"))
    d = a.unionByName(b)
    if aliases is not None:
        d = d.unionByName(b.join(aliases, F.col("eic_code") == F.col("parent")).select(F.col("alias").alias("eic_code"), "country", "plant_type", "unit_name", F.lit(1).alias("p")))
    return best_row(d.filter("eic_code IS NOT NULL"), ["eic_code"], [F.col("p")]).drop("p")
