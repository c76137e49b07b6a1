"""Row selection per key.

``row_number() = 1`` plans with a group limit before the shuffle: every task sends one row a
key at most, so a key that holds a large share of the table stays small behind it. Rows are
sorted once on either side; an aggregate over a struct of all columns would sort them twice and
compare them field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the largest by ``order``, ties by the remaining columns (maps, which
    have no order, by their JSON form).

    NULL ranks lowest. Negate numbers (or use ``last_first``) for ascending preference. The
    comparison of two rows ends at the first column in which they differ.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rest = [F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] else F.col(f"`{c}`") for c in df.columns if c not in keys]
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[c.desc_nulls_last() for c in (*order, *rest)])
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def low_first(c: Column) -> list[Column]:
    """Order terms that prefer the smallest number, missing last."""
    return [c.isNotNull(), -c]


def high_first(c: Column) -> list[Column]:
    return [c.isNotNull(), c]


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """NULL-safe equality of key tuples of two aliased frames."""
    cond = None
    for k in keys:
        c = F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
        cond = c if cond is None else cond & c
    return cond


def require(value: str, allowed: tuple[str, ...], name: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
