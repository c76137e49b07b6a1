"""Time helpers. Every timestamp is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

FAR_FUTURE = "9999-01-01 00:00:00"
FAR_PAST = "0001-01-02 00:00:00"
PERIODS = ("overall", "M", "MOY", "Y", "W", "WOY")


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def one_hour() -> Column:
    return F.expr("INTERVAL 1 HOUR")


def hours(n: float) -> Column:
    return F.expr(f"INTERVAL {int(round(n * 3600))} SECOND")


def parse_time(c) -> Column:
    """Mixed ISO text to timestamp, NULL for junk; timestamps pass through."""
    return F.try_to_timestamp(F.trim(col(c).cast("string")))


def floor_hour(c) -> Column:
    return F.date_trunc("hour", col(c))


def ceil_hour(c) -> Column:
    return F.date_trunc("hour", col(c) + F.expr("INTERVAL '59:59.999999' MINUTE TO SECOND"))


def hours_between(start, end) -> Column:
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(3_600_000_000.0)


def whole_hours(start, end) -> Column:
    return F.floor((F.unix_seconds(col(end)) - F.unix_seconds(col(start))) / 3600).cast("long")


def period_key(c, period: str) -> Column:
    """Calendar key of a timestamp; weeks are ISO weeks."""
    t = col(c)
    week = F.lpad(F.weekofyear(t).cast("string"), 2, "0")
    if period == "overall":
        return F.lit("ALL")
    if period == "M":
        return F.date_format(t, "yyyy-MM")
    if period == "MOY":
        return F.date_format(t, "MM")
    if period == "Y":
        return F.date_format(t, "yyyy")
    if period == "W":
        iso_year = F.extract(F.lit("YEAROFWEEK"), t)
        return F.concat(F.lpad(iso_year.cast("string"), 4, "0"), F.lit("-W"), week)
    if period == "WOY":
        return week
    raise ValueError(f"period must be one of {PERIODS}")


def period_unit(period: str) -> str | None:
    """Truncation unit of a period, or None when it has no inner boundary."""
    return {"overall": None, "M": "month", "MOY": "month", "Y": "year", "W": "week", "WOY": "week"}[period]


def year_start(c) -> Column:
    y = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.cast("double")
    return F.when(y.isNotNull(), F.make_date(y.cast("int"), F.lit(1), F.lit(1)).cast("timestamp"))
