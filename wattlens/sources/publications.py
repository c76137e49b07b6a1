"""Readers of published reference tables, of KPI tables and of plant registers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as sc
from ..functions.maths import try_num
from ..operators.compare import annual_from_monthly, eraa_reference, tyndp_reference
from .readers import read_text_table, sniff_separator

# How the publications name countries, technologies and fuels.
COUNTRY_ALIASES = {"UK": "GB"}
ERAA_TECHNOLOGIES = {
    "Gas": ["Fossil Gas"],
    "Nuclear": ["Nuclear"],
    "Coal": ["Fossil Brown coal/Lignite", "Fossil Hard coal"],
    "Other non-RES": ["Fossil Oil", "Other", "Biomass", "Waste", "Fossil Coal-derived gas", "Fossil Oil shale", "Fossil Peat"],
}
TYNDP_FUELS = {
    "Gas": "Fossil Gas",
    "Nuclear": "Nuclear",
    "Hard coal": "Fossil Hard coal",
    "Lignite": "Fossil Brown coal/Lignite",
    "Heavy oil": "Fossil Oil",
    "Light oil": "Fossil Oil",
    "Oil shale": "Fossil Oil shale",
}
# Spellings of columns in the plant matching register.
REGISTER_EIC = ["EIC", "eic", "Eic", "EICs", "eic_codes", "eic_list"]
REGISTER_CAPACITY = ["Capacity", "capacity", "Capacity_MW", "Cap_MW", "p_nom", "P_nom", "p_nom_mw", "P_nom_MW", "NetCapacity",
                     "GrossCapacity", "installed_capacity", "InstalledCapacity"]

#: Columns of KPI tables that are names; all others are numbers.
KPI_NAMES = {"country", "area", "area_code", "plant_type", "plant_type_code", "period", "period_key", "unit", "eic_code", "unit_name",
             "technology", "fuel_type", "scenario", "source", "source_path"}


def plain_names(names: list[str]) -> list[str]:
    """Lower-case names of letters, digits and single underscores. A name that another column
    has already gets the next free number behind it."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\W_]+", "_", name, flags=re.ASCII).strip("_").lower()
        got, n = base, 1
        while got in out:
            n += 1
            got = f"{base}_{n}"
        out.append(got)
    return out


def country_code(c: str) -> Column:
    """Upper-case code in the dataset's own spelling; unknown is blank."""
    code = F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    for theirs, ours in COUNTRY_ALIASES.items():
        code = F.when(code == theirs, ours).otherwise(code)
    return code


def read_kpi_table(spark: SparkSession, path: str, numbers: bool = True) -> DataFrame:
    """Parquet (by suffix) as it is; text with ``;`` or ``,`` under plain names.

    With ``numbers`` all columns of a text table but names (``KPI_NAMES``) become numbers; what is
    no number is NULL.
    """
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    d = read_text_table(spark, path, sniff_separator(spark, path, ";,")).drop("source_path")
    d = d.toDF(*plain_names(d.columns))
    return d.select(*[try_num(c).alias(c) if numbers and c not in KPI_NAMES else F.col(f"`{c}`") for c in d.columns])


def read_annual_kpis(spark: SparkSession, annual: str, monthly: str | None = None) -> DataFrame:
    """The annual KPI table, or one derived from the monthly table where no annual one exists."""
    def found(path: str) -> bool:
        try:
            return bool(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").head(1))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    if found(annual):
        return read_kpi_table(spark, annual)
    if monthly and found(monthly):
        return annual_from_monthly(read_kpi_table(spark, monthly))
    raise FileNotFoundError(f"neither annual nor monthly KPI table: {annual}, {monthly}")


def read_eraa(spark: SparkSession, path: str, technologies: dict[str, list[str]] = ERAA_TECHNOLOGIES) -> DataFrame:
    """Published outage rates by country, target year and plant type."""
    raw = read_kpi_table(spark, path)
    return eraa_reference(raw.withColumn("country", country_code("country")), technologies)


def read_tyndp(spark: SparkSession, path: str, fuels: dict[str, str] = TYNDP_FUELS, year: int = 2030, scenario: str = "NationalTrends") -> DataFrame:
    """Published forced rates and planned days by country and plant type."""
    raw = read_kpi_table(spark, path)
    return tyndp_reference(raw.withColumn("country", country_code("country")), fuels, year, scenario)


def read_jrc_register(spark: SparkSession, path: str) -> DataFrame:
    """The unit register with its fixed column names."""
    return sc.conform(read_text_table(spark, path, sniff_separator(spark, path)), sc.JRC_REGISTER)


def read_ppm_register(spark: SparkSession, path: str) -> DataFrame:
    """The matching register. Its first column is the index under any name; codes and capacity
    have several spellings, of the capacities the first that is a number counts."""
    raw = read_text_table(spark, path, sniff_separator(spark, path))
    first = raw.columns[0]
    if "Index" not in raw.columns:
        raw = raw.withColumnRenamed(first, "Index")
    codes = [c for c in REGISTER_EIC if c in raw.columns]
    if not codes:
        raise ValueError(f"{path} has no column of codes: {REGISTER_EIC}")
    sizes = [try_num(c) for c in REGISTER_CAPACITY if c in raw.columns]
    plain = raw.drop(*[c for c in REGISTER_CAPACITY if c in raw.columns])
    plain = raw.select(*[F.col(f"`{c}`") for c in plain.columns if c not in codes], F.col(f"`{codes[0]}`").alias("EIC"),
                       (F.coalesce(*sizes) if sizes else F.lit(None).cast("double")).alias("Capacity"))
    return sc.conform(plain, sc.PPM_REGISTER)
