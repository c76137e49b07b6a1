"""Published tables against our own: which column stands for a metric, and in which unit.

Published tables name and fill their columns differently. For each metric a chain of steps says
where its value may come from; the first step whose columns hold any value in the table is taken
for the whole table. What columns hold is one existence aggregate; whether a column is a
fraction or a percentage is decided by an exact quantile of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import floor0, try_num
from .compare import common_pairs
from .quantiles import quantiles
from .rows import require, same_keys

# Metrics that are compared by default, their kinds, and metrics kept in days or per day.
FORCED_METRICS = ("uFOR", "uEFOR", "uUOR", "uEUOR")
PLANNED_METRICS = ("uPOR", "uEPOR", "uSOR", "uESOR")
TOTAL_METRICS = ("uTOF", "uETOF")
DAYS = ("wRR_so_h", "wRR_uo_h")
PER_DAY = ("wFR_so_h", "wFR_uo_h")

# Names of columns that may hold a reference value, best first.
FORCED_RATES = ["uFOR", "FOR", "FOR_tyndp", "forced_outage_rate", "forced_outage_rate_pct", "average_forced_outage_rate",
                "weighted_average_forced_outage_rate", "forced_unavailability", "forced_unavailability_rate"]
FORCED_EQUIVALENT = ["uEFOR", "uEUOR", "uEFOF", "uEUOF", "wEFOR", "wEUOR"]
UNPLANNED = ["uUOR", "uUOF", "wUOR", "wUOF"]
PLANNED_EQUIVALENT = ["uEPOR", "uESOR", "uEPOF", "uESOF", "wEPOR", "wESOR", "wEPOF", "wESOF"]
PLANNED_RATES = ["uPOR", "uSOR", "uPOF", "uSOF", "POR", "POF", "SOR", "SOF", "wPOF_tyndp", "wSOF", "planned_outage_rate", "planned_outage_rate_pct",
                 "planned_unavailability", "planned_unavailability_rate", "scheduled_outage_rate", "scheduled_unavailability"]
PLANNED_DAYS = ["wPOD_tyndp", "POD", "planned_outage_days", "planned_outage_number_of_days", "planned_outage_days_per_year"]
SCHEDULED_ONLY = ["uSOR", "uSOF", "wSOR", "wSOF", "uPOR", "uPOF", "wPOF_tyndp"]
PLANNED_ONLY = ["uPOR", "uPOF", "wPOR", "wPOF", "wPOF_tyndp", "uSOR", "uSOF", "wSOF"]
TOTAL = ["uTOF", "wTOF", "TOF", "total_unavailability", "total_unavailability_rate", "total_unavailability_rate_pct"]
TOTAL_EQUIVALENT = ["uETOF", "wETOF", "ETOF", "total_equivalent_unavailability"]
UNAVAILABLE = ["uUOR", "uFOR", "uUOF", "wUOR", "wFOR", "wUOF"]
UNAVAILABLE_EQUIVALENT = ["uEUOR", "uEFOR", "wEUOR", "wEFOR", "uUOF", "wUOF", "uFOR", "wFOR"]


@dataclass(frozen=True)
class Rate:
    """A rate as it stands, in percent."""
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Difference:
    """A total rate less an unavailability, not below 0."""
    total: tuple[str, ...]
    less: tuple[str, ...]


@dataclass(frozen=True)
class OfDays:
    """Days a year as a percentage."""
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Sum:
    """Values of two other metrics; a missing one counts as 0 beside the other."""
    metrics: tuple[str, str]


def kind_of(metric: str) -> str:
    return "planned" if metric in PLANNED_METRICS else "total" if metric in TOTAL_METRICS else "forced"


def steps(kind: str, metric: str = "") -> list:
    """Where a metric's reference value may come from, best first."""
    require(kind, ("forced", "planned", "total"), "kind")
    if kind == "forced":
        own = FORCED_EQUIVALENT if metric in ("uEFOR", "uEUOR") else UNPLANNED if metric == "uUOR" else []
        return [Rate((*own, *FORCED_RATES))]
    if kind == "planned":
        rest = [Difference(tuple(TOTAL), tuple(UNAVAILABLE)), OfDays(tuple(PLANNED_DAYS))]
        if metric in ("uEPOR", "uESOR"):
            return [Rate(tuple(PLANNED_EQUIVALENT)), Difference(tuple(TOTAL_EQUIVALENT), tuple(UNAVAILABLE_EQUIVALENT)), *rest]
        return [Rate(tuple({"uSOR": SCHEDULED_ONLY, "uPOR": PLANNED_ONLY}.get(metric, PLANNED_RATES))), *rest]
    equivalent = metric == "uETOF"
    return [Rate(tuple(TOTAL_EQUIVALENT if equivalent else TOTAL)), Sum(("uEFOR", "uESOR") if equivalent else ("uFOR", "uSOR"))]


def name_key(name: str) -> str:
    """Column names in one spelling: small letters and digits, anything else one underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def filled_columns(df: DataFrame) -> dict[str, str]:
    """Spelling to name of the columns that hold any number: one aggregate over the table."""
    names = {name_key(c): c for c in df.columns}
    row = df.agg(*[F.count(try_num(c)).alias(f"n{i}") for i, c in enumerate(names.values())]).first()  # one row
    return {k: c for i, (k, c) in enumerate(names.items()) if row[f"n{i}"]}


def finite(c: str) -> Column:
    v = try_num(c)
    return F.when(F.abs(v) < float("inf"), v)


def percent(df: DataFrame, c: str, limit: float = 1.0) -> Column:
    """A column in percent: scaled where its 95th percentile over the table says it is a fraction."""
    high = quantiles(df, [], finite(c), {"q": 0.95}).select("q").scalar()
    return F.when(high <= limit, try_num(c) * 100.0).otherwise(try_num(c))


def reference_value(df: DataFrame, kind: str, metric: str = "", filled: dict[str, str] | None = None) -> Column:
    """Reference value of a metric for the rows of ``df``, one published table; NULL if no step applies."""
    filled = filled_columns(df) if filled is None else filled
    first = lambda names: next((filled[name_key(n)] for n in names if name_key(n) in filled), None)
    for step in steps(kind, metric):
        if isinstance(step, Rate) and (c := first(step.columns)):
            return percent(df, c)
        if isinstance(step, Difference) and (t := first(step.total)) and (u := first(step.less)):
            return floor0(percent(df, t) - percent(df, u))
        if isinstance(step, OfDays) and (c := first(step.columns)):
            return try_num(c) / 365.0 * 100.0
        if isinstance(step, Sum):
            a, b = (reference_value(df, kind_of(m), m, filled) for m in step.metrics)
            return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return F.lit(None).cast("double")


def own_value(df: DataFrame, metric: str) -> Column:
    """Our own value of a metric in the unit it is compared in: percent, days or per day."""
    if metric not in df.columns:
        return F.lit(None).cast("double")
    if metric in DAYS:
        return try_num(metric) / 24.0
    if metric in PER_DAY:
        return try_num(metric) * 24.0
    return percent(df, metric)


def default_metrics(source: str) -> list[str]:
    """Metrics that a publication is compared by: adequacy assessments publish forced rates only."""
    if "eraa" in source.strip().lower():
        return list(FORCED_METRICS)
    return ["uFOR", "uEFOR", "uUOR", "uEUOR", "uPOR", "uEPOR", "uSOR", "uESOR", "uTOF", "uETOF"]


def metric_rows(table: DataFrame, group: str, reference: str, own: str, metrics: list[str] | None = None) -> DataFrame:
    """Rows (country, ``group``, source, metric, value) of two labelled sources of one wide table.

    Values of a metric come through its fallback chain on the reference side and are kept for
    pairs of country and group that both sides have; where the reference has no value at all, our
    own rows of its pairs stay.
    """
    sides = {s: table.filter(F.trim("source") == s) for s in (reference, own)}
    filled = filled_columns(sides[reference])
    ids = ["country", group]
    out = None
    for m in metrics or default_metrics(reference):
        values = {reference: reference_value(sides[reference], kind_of(m), m, filled), own: own_value(sides[own], m)}
        row = {s: d.select(*ids, F.lit(s).alias("source"), F.lit(m).alias("metric"), values[s].alias("value")).filter(
            F.col("value").isNotNull() & F.col("country").isNotNull() & F.col(group).isNotNull()) for s, d in sides.items()}
        a, b = common_pairs(row[reference], row[own], ids)
        pairs = sides[reference].select(*ids).distinct().alias("p")
        alone = row[own].alias("o").join(pairs, same_keys("o", "p", ids), "left_semi").withColumn(
            "_any", row[reference].agg(F.count(F.lit(1))).scalar()).filter("_any = 0").drop("_any")
        part = a.unionByName(b).unionByName(alone)
        out = part if out is None else out.unionByName(part)
    return out
