"""Interval and point joins on nested time bins.

An interval lies in the bins of its own length class: the narrowest bins that are at least as long
as it, of which it touches two at most. Two intervals that overlap share a bin of the longer
one's class, so each side goes into its own class, and the other into all wider ones:
neither a long interval nor a busy stretch of short ones meets rows far away from it, and no
key is wider than a bin. A pair that shares two bins is kept in the first one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOUR = 3600
#: Widths of the bins in hours; longer intervals take several of the widest.
WIDTHS = (12, 96, 768, 6144, 49152)


def _own(length: Column, widths: tuple[int, ...]) -> Column:
    """Place in ``widths`` of an interval's class."""
    out = F.lit(len(widths) - 1)
    for i, w in reversed(list(enumerate(widths[:-1]))):
        out = F.when(length <= w * HOUR, i).otherwise(out)
    return out


def _width(widths: tuple[int, ...]) -> Column:
    """Seconds of the bins of ``_level``."""
    out = F.lit(widths[-1] * HOUR)
    for i, w in reversed(list(enumerate(widths[:-1]))):
        out = F.when(F.col("_level") == i, w * HOUR).otherwise(out)
    return out


def _classes(df: DataFrame, s: str, e: str, widths: tuple[int, ...]) -> Column:
    """The classes that intervals of ``df`` have, as an array."""
    return df.agg(F.collect_set(_own(F.col(e) - F.col(s), widths))).scalar()


def _with_bins(df: DataFrame, s: str, e: str, widths: tuple[int, ...], classes: str, of: Column | None = None) -> DataFrame:
    """Rows per class and bin (``_level``, ``_bin``) of ``classes``: the row's "own" class, all
    "wider" ones, or "all" from its own on, of these only those in ``of``, where given. ``s`` and
    ``e`` are seconds; ``e`` is exclusive."""
    last = F.greatest(F.col(e) - 1e-6, F.col(s))
    own = _own(F.col(e) - F.col(s), widths)
    if classes == "own":  # one short list of numbers a row
        d = df.withColumn("_level", own.cast("int")).withColumn("_width", _width(widths))
        return d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / F.col("_width")), F.floor(last / F.col("_width"))))).drop("_width")

    def span(i: int, w: int) -> Column:
        bins = F.sequence(F.floor(F.col(s) / (w * HOUR)), F.floor(last / (w * HOUR)))
        taken = {"own": own == i, "wider": own < i, "all": own <= i}[classes]
        taken = taken if of is None else taken & F.array_contains(of, F.lit(i))
        return F.when(taken, F.transform(bins, lambda b: F.struct(F.lit(i).alias("_level"), b.alias("_bin"))))

    none = F.array().cast("array<struct<_level:int,_bin:bigint>>")
    each = F.concat(*[F.coalesce(span(i, w), none) for i, w in enumerate(widths)])
    return df.withColumn("_each", F.explode(each)).select("*", "_each._level", "_each._bin").drop("_each")


def _seconds(c) -> Column:
    return F.unix_micros(c) / F.lit(1e6)


def _met(left: DataFrame, right: DataFrame, keys: list[str], widths: tuple[int, ...], where: Column | None, looked_up: bool) -> DataFrame:
    """Pairs whose stretches [_l0, _l1) and [_r0, _r1) (seconds) overlap."""
    overlap = (F.col("_l0") < F.col("_r1")) & (F.col("_r0") < F.col("_l1"))
    first = F.col("_bin") == F.floor(F.greatest("_l0", "_r0") / _width(widths))
    keep = overlap & first if where is None else overlap & first & where
    on = [*keys, "_level", "_bin"]
    in_left, in_right = (_classes(left, "_l0", "_l1", widths), _classes(right, "_r0", "_r1", widths)) if looked_up else (None, None)
    binned = lambda df, s, e, classes, of=None: _with_bins(df, s, e, widths, classes, of)
    longer_left = binned(left, "_l0", "_l1", "own").join(binned(right, "_r0", "_r1", "all", in_left), on).filter(keep)
    longer_right = binned(left, "_l0", "_l1", "wider", in_right).join(binned(right, "_r0", "_r1", "own"), on).filter(keep)
    return longer_left.unionByName(longer_right).drop("_level", "_bin", "_l0", "_l1", "_r0", "_r1")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str],
                 slack_hours: float = 0.0, where: Column | None = None, looked_up: bool = False) -> DataFrame:
    """Pairs with equal keys whose intervals overlap, the left one widened by ``slack_hours``.

    Column names other than the keys must differ between the sides; ``where`` is one more
    condition on the pair. ``looked_up``: read both sides once more to leave out the bins of
    classes that the other side has no interval of; for sides that are cheap to read.
    """
    slack = float(round(slack_hours * 3600))
    lw = left.withColumn("_l0", _seconds(F.col(l[0])) - slack).withColumn("_l1", _seconds(F.col(l[1])) + slack).filter("_l0 < _l1")
    rw = right.withColumn("_r0", _seconds(F.col(r[0]))).withColumn("_r1", _seconds(F.col(r[1]))).filter("_r0 < _r1")
    return _met(lw, rw, keys, WIDTHS, where, looked_up)


def match_hours(hours: DataFrame, intervals: DataFrame, key: str = "eic_code", at: str = "timestamp") -> DataFrame:
    """Each hourly row with the interval (``seg_start``, ``seg_end``) that holds it.

    Replaces exploding the intervals. An hour looks into one bin of each class and meets there only
    the intervals of that class; intervals that cross no month start (segments never do) need
    three classes.
    """
    widths = (24, 168, 768)
    h = hours.withColumnRenamed(key, "_key").withColumn("_t", _seconds(F.col(at)))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_level"), F.floor(F.col("_t") / (w * HOUR)).alias("_bin")) for i, w in enumerate(widths)]))
    points = h.withColumn("_each", each).select("*", F.col("_each._level").alias("_pl"), F.col("_each._bin").alias("_pb")).drop("_each")
    # intervals before the first or after the last hour meet none
    ends = hours.agg(F.struct(F.min(at).alias("a"), F.max(at).alias("b"))).scalar()
    intervals = intervals.filter((F.col("seg_end") > ends["a"]) & (F.col("seg_start") <= ends["b"]))
    iv = intervals.withColumn("_l0", _seconds(F.col("seg_start"))).withColumn("_l1", _seconds(F.col("seg_end"))).filter("_l0 < _l1")
    iv = _with_bins(iv, "_l0", "_l1", widths, "own")
    cond = (
        (F.col("_key") == F.col(key)) & (F.col("_pl") == F.col("_level")) & (F.col("_pb") == F.col("_bin"))
        & (F.col("_t") >= F.col("_l0")) & (F.col("_t") < F.col("_l1"))
    )
    return iv.join(points, cond).drop("_pl", "_pb", "_level", "_bin", "_t", "_l0", "_l1", "_key")
