"""Reliability factors, rates and event statistics per unit and per fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import floor0, nz, pooled_std, ratio
from ..functions.times import period_key
from .runs import hours_col, run_starts
from .segments import split_at_period

BLOCK_KEYS = ["country", "plant_type_code", "unit_name", "eic_code"]
EVENTS = ["FO", "EFO", "UO", "EUO", "PO", "EPO", "MO", "EMO", "SO", "ESO", "EFD", "EUD"]
CLASSES = ["P", "M", "F", "U", "S"]
FULL = {k: f"{k}OH" for k in CLASSES}
PART = {k: f"E{k}DH" for k in CLASSES}
MOMENTS = [f"{e}_{m}" for e in ("EFD", "EUD") for m in ("H", "S", "Q", "H_w", "S_w", "Q_w")]


def factor_terms(v: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator of every factor (xF, per active hour) and rate (xR, per
    service plus own hours), strict and equivalent."""
    act, sh = v["ACTH"], v["SH"]
    t = {"AF": (v["AH"], act), "EAF": (v["EAH"], act), "SF": (sh, act), "ESF": (v["ESH"], act), "RSF": (v["RSH"], act),
         "TOF": (v["OH"], act), "ETOF": (v["EOH"], act)}
    for k in CLASSES:
        full, eq = v[FULL[k]], v[FULL[k]] + v[PART[k]]
        t[f"{k}OF"], t[f"E{k}OF"] = (full, act), (eq, act)
        t[f"{k}OR"], t[f"E{k}OR"] = (full, sh + full), (eq, sh + full + v[PART[k]])
    return t


FACTORS = ["AF", "EAF", "SF", "ESF", "RSF", "TOF", "ETOF"] + [
    f"{e}{k}O{x}" for x in "FR" for e in ("", "E") for k in CLASSES]


def hour_terms(v: dict[str, Column]) -> dict[str, Column]:
    """Derived hours from sums (or from one row): outage, available, service hours.

    ``GSH`` (service hours from generation) replaces ``ACTH - OH - RSH`` when given.
    """
    v = dict(v)
    v["OH"] = v["POH"] + v["MOH"] + v["FOH"]
    v["EOH"] = v["OH"] + v["EPDH"] + v["EMDH"] + v["EFDH"]
    v["AH"], v["EAH"] = floor0(v["ACTH"] - v["OH"]), floor0(v["ACTH"] - v["EOH"])
    if "GSH" in v:
        v["SH"] = F.least(v["GSH"], v["AH"])
        v["RSH"] = floor0(v["AH"] - v["SH"])
    else:
        v["SH"] = floor0(v["AH"] - v["RSH"])
    v["ESH"] = floor0(v["EAH"] - v["RSH"])
    return v


def event_flags() -> dict[str, Column]:
    """Hour conditions of the event categories. Forced and unplanned ones count only in
    hours without any planned outage."""
    act = F.col("is_active")
    exposed = act & ~((nz("SOH") > 0) | (nz("ESDH") > 0))
    base = {"F": exposed, "U": exposed, "P": act, "M": act, "S": act}
    out = {}
    for k, b in base.items():
        full, part = nz(FULL[k]) > 0, nz(PART[k]) > 0
        out[f"{k}O"], out[f"E{k}O"] = b & full, b & (full | part)
        if k in "FU":
            out[f"E{k}D"] = b & part
    return out


def block_kpis(tallies: DataFrame, period: str = "M", internal: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Unit KPIs per period: one window pass for run starts, one aggregation, projections."""
    keys = keys or BLOCK_KEYS
    has_gsh = "GSH" in tallies.columns
    d = split_at_period(tallies, period).withColumn("period_key", period_key("seg_start", period))
    d = run_starts(d, keys, event_flags(), F.col("period_key"))
    d = d.withColumn("_h", hours_col().cast("double"))
    inst = F.greatest(nz("installed_capacity"), F.lit(0.0))
    act = F.col("is_active").cast("double")
    row = {"ACTH": act, **{c: nz(c).cast("double") for c in (*FULL.values(), *PART.values())}}
    row["RSH"] = floor0(nz("RSH")) if "RSH" in tallies.columns else F.lit(0.0)
    if has_gsh:
        row["GSH"] = F.least(floor0(nz("GSH")).cast("double"), F.lit(1.0))
    row = hour_terms(row)
    h = F.col("_h")
    aggs = [F.sum(act * h).cast("long").alias("ACTH"), F.sum(F.when(F.col("is_active"), inst * h).otherwise(0.0)).alias("cap_active_hours_MWh"),
            F.max(F.when(F.col("is_active"), inst).otherwise(0.0)).alias("cap_nameplate_MW")]
    for c in (*FULL.values(), *PART.values()):
        aggs.append(F.sum(nz(c) * h).cast("double").alias(c))
    aggs.append(F.sum((nz("RSH") if "RSH" in tallies.columns else F.lit(0.0)) * h).alias("RSH"))
    if has_gsh:
        aggs.append(F.sum(row["GSH"] * h).alias("GSH"))
    for e in EVENTS:
        aggs += [F.sum(F.col(f"{e}_start").cast("long")).alias(f"N_{e}"),
                 F.coalesce(F.sum(F.when(F.col(f"{e}_on"), h)), F.lit(0.0)).cast("long").alias(f"TOT_{e}_h")]
    mw = nz("derate_MW")
    for e in ("EFD", "EUD"):
        on = F.col(f"{e}_on").cast("double") * h
        for m, x in (("H", F.lit(1.0)), ("S", mw), ("Q", mw * mw)):
            aggs += [F.sum(on * x).alias(f"{e}_{m}"), F.sum(on * inst * x).alias(f"{e}_{m}_w")]
    if internal:
        for n, (a, b) in factor_terms(row).items():
            aggs += [F.sum(a * inst * h).alias(f"_w{n}_num"), F.sum(b * inst * h).alias(f"_w{n}_den")]
    g = d.groupBy(*keys, "period_key").agg(*aggs)
    v = hour_terms({c: F.col(c) for c in ("ACTH", *FULL.values(), *PART.values(), "RSH", *(["GSH"] if has_gsh else []))})
    g = g.withColumn("cap_weight_MW", ratio("cap_active_hours_MWh", "ACTH"))
    cols = {**{c: v[c] for c in ("OH", "EOH", "AH", "EAH", "SH", "ESH", "RSH")}, "D_h": v["SH"]}
    cols |= {f"{k}OD_h": F.col(FULL[k]) + F.col(PART[k]) for k in CLASSES}
    cols |= {n: ratio(a, b) for n, (a, b) in factor_terms(v).items()}
    for e in ("EFD", "EUD"):
        cols[f"{e}_mw_mean"] = ratio(f"{e}_S", f"{e}_H")
        cols[f"{e}_mw_std"] = pooled_std(F.col(f"{e}_Q"), F.col(f"{e}_S"), F.col(f"{e}_H"))
    for e, name in RATE_NAMES.items():
        cols[f"RR_{name}_h"] = ratio(f"N_{e}", f"TOT_{e}_h")
        if e in ("EFO", "FO", "EUO", "UO"):
            cols[f"FR_{name}_h"] = ratio(F.col(f"N_{e}"), v["SH"])
    out = g.select("*", *[c.alias(f"_o_{n}") for n, c in cols.items()])
    out = out.drop(*[n for n in cols if n in g.columns]).withColumnsRenamed({f"_o_{n}": n for n in cols})
    if not internal:
        out = out.drop(*MOMENTS, "cap_nameplate_MW", "GSH")
    return out


RATE_NAMES = {"EFO": "efo", "FO": "fo", "EUO": "eun", "UO": "un", "EPO": "epo", "PO": "po", "EMO": "emo", "MO": "mo",
              "ESO": "eso", "SO": "so"}

# Fleet groupings: mode -> columns.
FLEET_GROUPS = {"plant_type": ["country", "plant_type"], "plant_tech": ["country", "plant_tech"]}


def fleet_labels(df: DataFrame, group: list[str]) -> DataFrame:
    """Blank grouping labels become 'Unknown'."""
    t = lambda c: F.trim(F.col(c).cast("string"))
    blank = lambda c: F.when(t(c).isNull() | t(c).isin("", "nan", "none", "null", "na", "n/a"), "Unknown").otherwise(t(c))
    return df.withColumns({c: blank(c) for c in group})


def fleet_kpis(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Fleet table from block KPIs with internal columns: factors as ratios of sums, plain
    (u) and weighted by capacity (w), event rates plain and weighted, pooled magnitudes.
    Everything comes from one aggregation."""
    df = fleet_labels(blocks, group)
    cap = nz("cap_weight_MW")
    aggs = [F.sum(c).alias(c) for c in ("ACTH", *FULL.values(), *PART.values(), "RSH", "cap_active_hours_MWh", "D_h")]
    aggs += [F.sum(f"_w{n}_{p}").alias(f"_w{n}_{p}") for n in FACTORS for p in ("num", "den")]
    alive = F.col("ACTH") > 0
    aggs += [F.count_distinct(F.when(alive, F.col("eic_code"))).cast("double").alias("n_units"),
             F.round(F.coalesce(F.sum(F.when(alive, F.col("cap_nameplate_MW"))), F.lit(0.0)), 0).alias("cap_total_MW"),
             F.sum(F.col("D_h") * cap).alias("_dc")]
    for e in EVENTS:
        for c in (f"N_{e}", f"TOT_{e}_h"):
            aggs += [F.sum(c).alias(c), F.sum(F.col(c) * cap).alias(f"_c{c}")]
    aggs += [F.sum(m).alias(m) for m in MOMENTS]
    g = df.groupBy(*group, "period_key").agg(*aggs)
    v = hour_terms({c: F.col(c) for c in ("ACTH", *FULL.values(), *PART.values(), "RSH")})
    cols = {c: v[c] for c in ("OH", "EOH", "AH", "EAH", "SH", "ESH")}
    cols |= {f"u{n}": ratio(a, b) for n, (a, b) in factor_terms(v).items()}
    cols |= {f"w{n}": ratio(f"_w{n}_num", f"_w{n}_den") for n in FACTORS}
    for e in EVENTS:
        n, t, low = f"N_{e}", f"TOT_{e}_h", e.lower()
        cols[f"RR_{low}_h"], cols[f"FR_{low}_h"] = ratio(n, t), ratio(n, "D_h")
        cols[f"wRR_{low}_h"], cols[f"wFR_{low}_h"] = ratio(f"_c{n}", f"_c{t}"), ratio(f"_c{n}", "_dc")
    for e in ("EFD", "EUD"):
        for p, s in (("", ""), ("w", "_w")):
            q, s1, hh = (F.col(f"{e}_{m}{s}") for m in ("Q", "S", "H"))
            cols[f"{p}{e}_mw_mean"], cols[f"{p}{e}_mw_std"] = ratio(s1, hh), pooled_std(q, s1, hh)
    out = g.select("*", *[c.alias(n) for n, c in cols.items()])
    drop = [c for c in g.columns if c.startswith("_")] + MOMENTS
    return out.drop(*drop)


def plant_dimension(plants: DataFrame, year: int, age_bins: list[float], age_labels: list[str],
                    size_bins: list[float], size_labels: list[str]) -> DataFrame:
    """Unit attributes for grouping: technology, combined heat, age and size classes."""
    from ..functions import binning
    from .rows import best_row

    d = best_row(plants, ["unit_eic"], [])
    code, tech = F.col("fuel_type_code"), F.trim("plant_tech")
    low = F.lower(F.coalesce(tech, F.lit("")))
    hydro = low.rlike(r"\breservoir\b|\brun[- ]?of[- ]?river\b|\bpumped\b.*\bstorage\b|\bmarine\b")
    unknown = low.rlike(r"^(na|n/?a|n\.a\.|nan|none|null|missing|unknown|tbd|-{1,2}|—|–|\.)?$")
    d = d.withColumnRenamed("technology", "plant_tech").withColumn("plant_tech", (
        F.when(code == "B14", "Nuclear").when(code.isin("B10", "B11", "B12", "B13") | hydro, "Hydro")
        .when(code.isin("B15", "B16", "B18", "B19"), "RES").when(~unknown, tech)))
    age = F.when(F.col("year_commissioned").isNotNull(), F.greatest(F.lit(year) - F.col("year_commissioned"), F.lit(0.0)))  # unknown stays unknown
    chp = F.upper(F.trim(F.coalesce("set", F.lit("")))) == "CHP"
    res = code.isin("B10", "B11", "B12", "B13", "B15", "B16", "B18", "B19")
    return d.select(
        "country", F.col("fuel_type").alias("plant_type"), F.trim("unit_eic").alias("eic_code"), "plant_tech",
        F.when(chp, "CHP").when(F.col("set").isNotNull() | res, "no CHP").alias("is_chp"),
        age.alias("age_years"), binning.bins(age, age_bins, age_labels).alias("age_class"),
        binning.bins("unit_installed_capacity", size_bins, size_labels, right=False).alias("size_class"),
    )


def enrich(tallies: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach plant attributes; the dimension is one row per (country, type, unit)."""
    from .rows import best_row

    keys = ["country", "plant_type", "eic_code"]
    dim = best_row(dimension, keys, [])
    return tallies.join(dim, keys, "left")
