"""Labelled bins. ``right`` bins are (a, b] with the lowest edge included."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def bins(c, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Label of the bin holding c; NULL outside [edges[0], edges[-1]].

    ``edges`` may start with -inf and end with inf.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    c = col(c)
    out = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if right:
            low = (c >= lo) if i == 0 else (c > lo)
            high = c <= hi
        else:
            low, high = c >= lo, c < hi
        parts = [p for p, e in ((low, lo), (high, hi)) if abs(e) != float("inf")]
        cond = c.isNotNull()
        for p in parts:
            cond = cond & p
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out
