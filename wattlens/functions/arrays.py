"""Id lists: arrays inside the library, ``|``-joined text at the edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def split_ids(c) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\|"), lambda x: x != "")


def join_ids(a) -> Column:
    """Distinct non-blank ids in list order."""
    a = F.filter(col(a), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(a), "|")


def id_listed(lst, item) -> Column:
    return F.coalesce(F.array_contains(split_ids(lst), col(item)), F.lit(False))


def text_set(c, sep: str = "|") -> Column:
    """Sorted distinct non-blank values of a group. Only for columns whose distinct
    values per group are few (names, files, statuses); the set is built map-side first."""
    v = F.trim(col(c).cast("string"))
    return F.array_join(F.array_sort(F.collect_set(F.when(v != "", v))), sep)
