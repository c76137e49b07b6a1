"""Installed capacity as a slowly changing dimension, and the lookup in force at a time.

A keyed interval table has ``key_kind, key, valid_from, valid_to, mw``. A unit uses the
first kind it has a key for (see ``KIND_ORDER``), even when that key's intervals do not
cover the asked time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import codes, text
from ..functions.maths import num
from ..functions.times import ts
from .rows import best_row

# Lookup precedence; the plant kinds apply only to units reported at plant level.
KIND_ORDER = [
    "plant_map_plant", "plant_map_plant_norm", "plant_map", "plant_map_norm", "eic", "eic_alias", "name",
]


def conform_capacity(df: DataFrame) -> DataFrame:
    """Clean a conformed ``unit_capacity`` table: country, canonical type, name key."""
    code = codes.plant_type_code("plant_type")
    label = F.coalesce(codes.plant_type_label(code), text.canonical_plant_type("plant_type"))
    return df.filter(
        text.clean("unit_eic").isNotNull() & F.col("valid_from").isNotNull()
    ).select(
        text.clean("unit_eic").alias("unit_eic"), "unit_name",
        text.unit_name_key("unit_name").alias("unit_name_key"),
        codes.country_of_label("area_map_code").alias("country"),
        label.alias("plant_type"), F.upper(F.trim("status")).alias("status"),
        "valid_from", "valid_to", num("unit_installed_capacity").alias("unit_installed_capacity"), "update_time",
    )


def active_intervals(df: DataFrame) -> DataFrame:
    """Versions of capacity states to active intervals.

    Latest update per (unit, valid_from), a missing update time counting as latest; every
    interval ends where the unit's next state starts; only commissioned (or unmarked)
    states with positive capacity and positive length remain.
    """
    latest = best_row(df, ["unit_eic", "valid_from"], [F.col("update_time").isNull(), F.col("update_time")])
    # one row per distinct start of a unit: the window holds a unit's states, not its reports
    nxt = F.lead("valid_from").over(Window.partitionBy("unit_eic").orderBy("valid_from"))
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    return (
        latest.withColumn("valid_to", F.least("valid_to", nxt))
        .filter(status.isin("", "COMMISSIONED"))
        .filter(F.col("unit_installed_capacity") > 0)
        .filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    )


def close_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Cut each interval where the key's next one starts (as-of semantics: a newer
    interval hides an older one even after it has ended itself)."""
    nxt = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from"))
    return intervals.withColumn("valid_to", F.least("valid_to", nxt))


def asof_capacity(rows: DataFrame, intervals: DataFrame, keys: list[str], at: str, out: str = "mw") -> DataFrame:
    """Backward as-of join with validity check: adds ``out`` (NULL without a match).

    ``intervals`` carries ``keys, valid_from, valid_to`` and the value column ``out``, one
    row per (keys, valid_from). After closing, intervals of a key are disjoint, so the
    range join returns at most one match; the equi keys let Spark pick a broadcast or a
    shuffle join by size, and AQE splits a hot key on the rows' side.
    """
    iv = close_intervals(intervals.select(*keys, "valid_from", "valid_to", out), keys).alias("iv")
    cond = [F.col(f"r.`{k}`") == F.col(f"iv.`{k}`") for k in keys]
    t = F.col(f"r.`{at}`")
    cond += [t >= F.col("iv.valid_from"), F.col("iv.valid_to").isNull() | (t < F.col("iv.valid_to"))]
    return rows.alias("r").join(iv, cond, "left").select("r.*", F.col(f"iv.`{out}`").alias(out))


def plant_map_ranked(pm: DataFrame) -> DataFrame:
    """Complete the normalised keys of the plant map and add its preference rank."""
    fill = lambda a, b: F.coalesce(text.clean(a), F.when(text.eic_norm(b) != "", text.eic_norm(b)))
    return (
        pm.withColumn("unit_eic_norm", fill("unit_eic_norm", "unit_eic"))
        .withColumn("plant_eic_norm", fill("plant_eic_norm", "plant_eic"))
        .withColumn("source_id_norm", fill("source_id_norm", "source_id"))
        .withColumn("pref", F.struct(
            F.lower(F.coalesce("duplicate_status", F.lit(""))) == "kept",
            ~text.is_true_like("unit_eic_is_synthetic"),
            F.coalesce("ppm_match_score", F.lit(-1.0)),
        ))
    )


def plant_map_unit_intervals(pm: DataFrame) -> DataFrame:
    """Unit intervals of the plant map under all its code keys (one per key and start)."""
    mw = F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in
                      ("unit_installed_capacity", "plant_installed_capacity", "ppm_capacity")])
    start = F.coalesce(_year(F.col("year_commissioned")), ts("1900-01-01"))
    stop = _year(F.col("year_decommissioned"))
    keys = F.array(
        *[F.struct(F.lit(kind).alias("key_kind"), text.clean(c).alias("key")) for kind, c in
          (("plant_map", "unit_eic"), ("plant_map", "source_id"),
           ("plant_map_norm", "unit_eic_norm"), ("plant_map_norm", "source_id_norm"))]
    )
    rows = (
        plant_map_ranked(pm)
        .select("pref", F.explode(F.array_distinct(keys)).alias("k"), start.alias("valid_from"),
                stop.alias("valid_to"), mw.alias("mw"))
        .select("k.key_kind", "k.key", "valid_from", "valid_to", "mw", "pref")
        .filter(F.col("key").isNotNull() & F.col("mw").isNotNull())
        .filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    )
    return best_row(rows, ["key_kind", "key", "valid_from"], [F.col("pref")]).drop("pref")


def _year(c):
    return F.when(c.isNotNull(), F.make_date(c.cast("int"), F.lit(1), F.lit(1)).cast("timestamp"))


def plant_capacity_series(pm: DataFrame) -> DataFrame:
    """Capacity of a plant over time: the sum of its units between their start and end
    years, equal neighbours merged; plants without usable units fall back to one fixed value.

    Unit ends and starts become +/- steps that are summed per date before the running
    sum, so the window sees at most one row per plant and calendar year.
    """
    ranked = plant_map_ranked(pm).filter(F.col("plant_eic_norm").isNotNull())
    unit_key = text.first_present("unit_eic_norm", "source_id_norm", "name_key", "unit_eic", "source_id")
    units = best_row(
        ranked.filter(F.col("unit_installed_capacity") > 0)
        .withColumn("unit_key", F.coalesce(unit_key, F.concat(F.lit("row:"), F.to_json(F.struct("*"))))),
        ["plant_eic_norm", "unit_key"], [F.col("pref")],
    ).select(
        "plant_eic_norm", F.col("unit_installed_capacity").alias("mw"),
        F.coalesce(_year(F.col("year_commissioned")), ts("1900-01-01")).alias("t0"),
        _year(F.col("year_decommissioned")).alias("t1"),
    ).filter(F.col("t1").isNull() | (F.col("t1") > F.col("t0")))
    steps = units.select(
        "plant_eic_norm",
        F.explode(F.array(
            F.struct(F.col("t0").alias("t"), F.col("mw").alias("d"), F.lit(1).alias("n")),
            F.struct(F.col("t1").alias("t"), (-F.col("mw")).alias("d"), F.lit(-1).alias("n")),
        )).alias("s"),
    ).select("plant_eic_norm", "s.*").filter(F.col("t").isNotNull())
    w = Window.partitionBy("plant_eic_norm").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    levels = (
        steps.groupBy("plant_eic_norm", "t").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
        .select(
            "plant_eic_norm", F.col("t").alias("valid_from"),
            F.lead("t").over(w).alias("valid_to"),
            F.when(F.sum("n").over(run) > 0, F.round(F.sum("d").over(run), 6)).otherwise(0.0).alias("mw"),
        )
    )
    prev = F.lag("mw").over(Window.partitionBy("plant_eic_norm").orderBy("valid_from"))
    isl = F.sum((~F.col("mw").eqNullSafe(prev)).cast("int")).over(
        Window.partitionBy("plant_eic_norm").orderBy("valid_from").rowsBetween(Window.unboundedPreceding, 0))
    series = (
        levels.withColumn("isl", isl).filter(F.col("mw") > 0)
        .groupBy("plant_eic_norm", "isl")
        .agg(F.min("valid_from").alias("valid_from"),
             F.when(F.max(F.col("valid_to").isNull()), F.lit(None)).otherwise(F.max("valid_to")).alias("valid_to"),
             F.max("mw").alias("mw"))
        .select("plant_eic_norm", "valid_from", "valid_to", "mw")
    )
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    fixed = (
        ranked.groupBy("plant_eic_norm")
        .agg(
            F.coalesce(F.max(pos("plant_installed_capacity")), F.max(pos("ppm_capacity"))).alias("mw"),
            F.coalesce(_year(F.min("year_commissioned")), ts("1900-01-01")).alias("valid_from"),
            F.when(F.count("year_decommissioned") == F.count(F.lit(1)),
                   _year(F.max("year_decommissioned"))).alias("t1"),
        )
        .join(series.select("plant_eic_norm").distinct(), "plant_eic_norm", "left_anti")
    )
    unit_sum = best_row(
        ranked.filter(F.col("unit_installed_capacity") > 0), ["plant_eic_norm", "unit_eic_norm"], [F.col("pref")]
    ).groupBy("plant_eic_norm").agg(F.sum("unit_installed_capacity").alias("sum_mw"))
    fallback = (
        fixed.join(unit_sum, "plant_eic_norm", "left")
        .select("plant_eic_norm", "valid_from",
                F.when(F.col("t1") > F.col("valid_from"), F.col("t1")).alias("valid_to"),
                F.coalesce("mw", "sum_mw").alias("mw"))
        .filter(F.col("mw") > 0)
    )
    return series.unionByName(fallback)


def w_aliases(w_codes: DataFrame, capacity_codes: DataFrame) -> DataFrame:
    """(alias, parent) where the code itself has no capacity but its parent has."""
    w = w_codes.select(text.squash("eic_code").alias("alias"), text.squash("eic_parent").alias("parent"),
                       (F.upper(F.coalesce("eic_status", F.lit(""))) == "ACTIVE").alias("active"))
    w = w.filter((F.col("alias") != "") & (F.col("parent") != "") & (F.col("alias") != F.col("parent")))
    known = capacity_codes.select(F.col("unit_eic").alias("code")).distinct()
    w = w.join(known, F.col("alias") == F.col("code"), "left_anti")
    w = w.join(known, F.col("parent") == F.col("code"), "left_semi")
    return best_row(w, ["alias"], [F.col("active")]).select("alias", "parent")


def capacity_lookup(
    capacity: DataFrame, w_codes: DataFrame | None = None, plant_map: DataFrame | None = None
) -> DataFrame:
    """All keyed intervals: unit code, unit name, alias of a parent, plant map (unit and plant)."""
    direct = capacity.select(
        F.lit("eic").alias("key_kind"), F.trim("unit_eic").alias("key"), "valid_from", "valid_to",
        F.col("unit_installed_capacity").alias("mw"))
    named = best_row(
        capacity.filter(F.col("country").isNotNull() & F.col("plant_type").isNotNull() & (F.col("unit_name_key") != ""))
        .select(F.lit("name").alias("key_kind"),
                F.concat_ws("|", "country", "plant_type", "unit_name_key").alias("key"),
                "valid_from", "valid_to", F.col("unit_installed_capacity").alias("mw"), "unit_eic"),
        ["key_kind", "key", "valid_from"], [F.col("unit_eic")],
    ).drop("unit_eic")
    out = direct.unionByName(named)
    if w_codes is not None:
        al = w_aliases(w_codes, capacity)
        out = out.unionByName(
            direct.join(al, F.col("key") == F.col("parent"))
            .select(F.lit("eic_alias").alias("key_kind"), F.col("alias").alias("key"), "valid_from", "valid_to", "mw"))
    if plant_map is not None:
        out = out.unionByName(plant_map_unit_intervals(plant_map))
        series = plant_capacity_series(plant_map)
        names = plant_map_ranked(plant_map).filter(F.col("plant_eic_norm").isNotNull()).select(
            "plant_eic_norm", text.clean("plant_eic").alias("code")).filter(F.col("code").isNotNull()).distinct()
        plants = series.join(names, "plant_eic_norm").select(
            F.lit("plant_map_plant").alias("key_kind"), F.col("code").alias("key"), "valid_from", "valid_to", "mw"
        ).unionByName(series.select(
            F.lit("plant_map_plant_norm").alias("key_kind"), F.col("plant_eic_norm").alias("key"),
            "valid_from", "valid_to", "mw"))
        out = out.unionByName(best_row(plants, ["key_kind", "key", "valid_from"], [F.col("mw")]))
    return out


def choose_keys(units: DataFrame, lookup: DataFrame, allow_name: bool = True) -> DataFrame:
    """(unit_eic, key_kind, key): the first kind in ``KIND_ORDER`` the unit has a key for.

    ``units`` has one row per unit: unit_eic, is_plant_level and, for names, country,
    plant_type, unit_name.
    """
    norm = text.eic_norm("unit_eic")
    value = {
        "plant_map_plant": F.when(F.col("is_plant_level"), F.col("unit_eic")),
        "plant_map_plant_norm": F.when(F.col("is_plant_level"), norm),
        "plant_map": F.col("unit_eic"), "plant_map_norm": norm,
        "eic": F.col("unit_eic"), "eic_alias": F.col("unit_eic"),
    }
    if allow_name:
        value["name"] = F.concat(F.col("country"), F.lit("|"), F.col("plant_type"), F.lit("|"),
                                 text.unit_name_key("unit_name"))
    cand = units.select("unit_eic", F.explode(F.array(*[
        F.struct(F.lit(KIND_ORDER.index(k)).alias("prio"), F.lit(k).alias("key_kind"), v.alias("key"))
        for k, v in value.items()])).alias("c")).select("unit_eic", "c.*").filter(F.col("key").isNotNull())
    have = lookup.select("key_kind", "key").distinct()
    return (
        cand.join(have, ["key_kind", "key"])
        .groupBy("unit_eic").agg(F.min(F.struct("prio", "key_kind", "key")).alias("c"))
        .select("unit_eic", "c.key_kind", "c.key")
    )


def attach_capacity(rows: DataFrame, lookup: DataFrame, at: str, unit: str = "unit_eic",
                    allow_name: bool = True, out: str = "ext_capacity") -> DataFrame:
    """Add the capacity in force at ``at`` for each row's unit."""
    have = set(rows.columns)
    opt = lambda c: F.min(c) if c in have else F.lit(None).cast("string")
    plant_level = (
        F.max(F.upper(F.trim(F.coalesce("asset_type", F.lit("")))) == "PRODUCTION")
        if "asset_type" in have else F.lit(False)
    )
    spelled = rows.filter(F.col(unit).isNotNull()).groupBy(unit).agg(
        plant_level.alias("is_plant_level"), opt("country").alias("country"),
        opt("plant_type").alias("plant_type"), opt("unit_name").alias("unit_name"))
    units = spelled.groupBy(F.trim(unit).alias("_unit")).agg(
        F.max("is_plant_level").alias("is_plant_level"), *[F.min(c).alias(c) for c in ("country", "plant_type", "unit_name")])
    units = units.withColumnRenamed("_unit", "unit_eic")
    chosen = choose_keys(units, lookup, allow_name and {"country", "plant_type", "unit_name"} <= have)
    iv = chosen.join(lookup, ["key_kind", "key"]).select(
        F.col("unit_eic").alias("_unit"), "valid_from", "valid_to", F.col("mw").alias(out))
    # keyed as the rows spell their unit: rows that are dealt by unit stay where they are
    iv = spelled.select(unit, F.trim(unit).alias("_unit")).join(iv, "_unit").drop("_unit")
    return asof_capacity(rows, iv, [unit], at, out)
