"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def num(c) -> Column:
    """Double with NaN turned into NULL, so that comparisons never admit NaN."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d), d)


def try_num(name: str) -> Column:
    d = F.expr(f"try_cast(`{name}` as double)")
    return F.when(~F.isnan(d), d)


def ratio(n, d) -> Column:
    """n / d, NULL unless d > 0."""
    return F.when(col(d) > 0, col(n).cast("double") / col(d).cast("double"))


def floor0(c) -> Column:
    """max(x, 0), keeping NULL."""
    c = col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def nz(c, v=0.0) -> Column:
    return F.coalesce(col(c), F.lit(v))


def clip(c, low, high) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sum0(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def hold(p: Column) -> Column:
    """Predicate whose unknown counts as false."""
    return F.coalesce(p, F.lit(False))


def weighted_mean(x, w) -> Column:
    """Mean of x weighted by w over rows where both exist and w > 0."""
    x, w = col(x), col(w)
    ok = x.isNotNull() & (w > 0)
    return ratio(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))


def pooled_std(q, s, h) -> Column:
    """Population deviation from the moments sum(x^2), sum(x), n."""
    mean = ratio(s, h)
    return F.sqrt(floor0(ratio(q, h) - mean * mean))
