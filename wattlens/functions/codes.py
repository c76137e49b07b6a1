"""Code lists of the public transparency data, as plain text tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .text import canonical_plant_type, clean, col

# Production type codes and labels.
PLANT_TYPES = {
    "A03": "Mixed", "A04": "Generation", "A05": "Load",
    "B01": "Biomass", "B02": "Fossil Brown coal/Lignite", "B03": "Fossil Coal-derived gas",
    "B04": "Fossil Gas", "B05": "Fossil Hard coal", "B06": "Fossil Oil", "B07": "Fossil Oil shale",
    "B08": "Fossil Peat", "B09": "Geothermal", "B10": "Hydro Pumped Storage",
    "B11": "Hydro Run-of-river and poundage", "B12": "Hydro Water Reservoir", "B13": "Marine",
    "B14": "Nuclear", "B15": "Other renewable", "B16": "Solar", "B17": "Waste",
    "B18": "Wind Offshore", "B19": "Wind Onshore", "B20": "Other", "B21": "AC Link",
    "B22": "DC Link", "B23": "Substation", "B24": "Transformer", "B99": "Energy storage",
}

# Market area label and its area code.
AREAS = {
    "AL": "10YAL-KESH-----5", "AT": "10YAT-APG------L", "BA": "10YBA-JPCC-----D",
    "BE": "10YBE----------2", "BG": "10YCA-BULGARIA-R", "CH": "10YCH-SWISSGRIDZ",
    "CZ": "10YCZ-CEPS-----N", "DE": "10Y1001A1001A83F", "DE_50HZ": "10YDE-VE-------2",
    "DE_AMPRION": "10YDE-RWENET---I", "DE_TENNET": "10YDE-EON------1",
    "DE_TRANSNET": "10YDE-ENBW-----N", "DK": "10Y1001A1001A65H", "DK_1": "10YDK-1--------W",
    "DK_2": "10YDK-2--------M", "EE": "10Y1001A1001A39I", "ES": "10YES-REE------0",
    "FI": "10YFI-1--------U", "FR": "10YFR-RTE------C", "GB": "10YGB----------A",
    "GB_NIR": "10Y1001A1001A016", "GR": "10YGR-HTSO-----Y", "HR": "10YHR-HEP------M",
    "HU": "10YHU-MAVIR----U", "IE": "10YIE-1001A00010", "IT": "10YIT-GRTN-----B",
    "IT_CALA": "10Y1001C--00096J", "IT_CNOR": "10Y1001A1001A70O", "IT_CSUD": "10Y1001A1001A71M",
    "IT_NORD": "10Y1001A1001A73I", "IT_SARD": "10Y1001A1001A74G", "IT_SICI": "10Y1001A1001A75E",
    "IT_SUD": "10Y1001A1001A788", "LT": "10YLT-1001A0008Q", "LU": "10YLU-CEGEDEL-NQ",
    "LV": "10YLV-1001A00074", "MD": "10Y1001A1001A990", "ME": "10YCS-CG-TSO---S",
    "MK": "10YMK-MEPSO----8", "MT": "10Y1001A1001A93C", "NL": "10YNL----------L",
    "NO": "10YNO-0--------C", "NO_1": "10YNO-1--------2", "NO_2": "10YNO-2--------T",
    "NO_2A": "10Y1001C--001219", "NO_3": "10YNO-3--------J", "NO_4": "10YNO-4--------9",
    "NO_5": "10Y1001A1001A48H", "PL": "10YPL-AREA-----S", "PT": "10YPT-REN------W",
    "RO": "10YRO-TEL------P", "RS": "10YCS-SERBIATSOV", "SE": "10YSE-1--------K",
    "SE_1": "10Y1001A1001A44P", "SE_2": "10Y1001A1001A45N", "SE_3": "10Y1001A1001A46L",
    "SE_4": "10Y1001A1001A47J", "SI": "10YSI-ELES-----O", "SK": "10YSK-SEPS-----K",
    "UA": "10Y1001C--00003F", "UA_BEI": "10YUA-WEPS-----0", "UA_DOBTPP": "10Y1001A1001A869",
    "UA_IPS": "10Y1001C--000182", "XK": "10Y1001C--00100H",
}

# Areas whose country is not the part before the underscore.
COUNTRY_EXCEPTIONS = {"GB_NIR": "NI"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a literal code list; folded into the expression, no join needed."""
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def plant_type_code(c) -> Column:
    """Code of a production type given as label or code; 'Unknown' otherwise."""
    by_label = {_canon(v): k for k, v in PLANT_TYPES.items()}
    t = canonical_plant_type(c)
    code = F.upper(F.trim(col(c).cast("string")))
    return F.coalesce(
        lookup(by_label, t), F.when(code.isin(*PLANT_TYPES), code), F.lit("Unknown")
    )


def plant_type_label(code) -> Column:
    return lookup(PLANT_TYPES, col(code))


def _canon(label: str) -> str:
    t = label.lower()
    for ch in "-_/":
        t = t.replace(ch, " ")
    return " ".join(t.split())


def country_of_label(c) -> Column:
    """ISO country of an area label such as ``DE_50HZ``; NULL when it does not start with one."""
    t = clean(c)
    head = F.upper(F.trim(F.regexp_extract(t, r"^([^_\-\s/]*)", 1)))
    return F.coalesce(lookup(COUNTRY_EXCEPTIONS, t), F.when(head.rlike("^[A-Z]{2}$"), head))


def area_label(code, map_code=None, y_label=None) -> Column:
    """Label of an area code: static list, then the map code, then the directory label."""
    by_code = {v: k for k, v in AREAS.items()}
    parts = [lookup(by_code, clean(code))]
    for extra in (map_code, y_label):
        if extra is not None:
            parts.append(clean(extra))
    return F.coalesce(*parts, F.lit("Unknown"))
