"""String normalisers as Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Trimmed text, NULL when blank."""
    t = F.trim(col(c).cast("string"))
    return F.when(t != "", t)


def first_present(*cols) -> Column:
    """First value that is neither NULL nor blank."""
    return F.coalesce(*[clean(c) for c in cols])


def squash(c) -> Column:
    """Trimmed text with inner whitespace runs reduced to one blank; '' for NULL."""
    return F.coalesce(F.regexp_replace(F.trim(col(c).cast("string")), r"\s+", " "), F.lit(""))


def eic_norm(c) -> Column:
    """Upper-case identifier without separators."""
    return F.regexp_replace(F.upper(squash(c)), "[^0-9A-Z]+", "")


def canonical_plant_type(c) -> Column:
    t = F.regexp_replace(col(c).cast("string"), "\u00A0", " ")
    t = F.regexp_replace(F.trim(t), r"[-_/]+", " ")
    t = F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    aliases = (
        "hydro run and river and pondage",
        "hydro run and river and poundage",
        "hydro run of river and pondage",
    )
    return F.coalesce(F.when(t.isin(*aliases), F.lit("hydro run of river and poundage")).otherwise(t), F.lit(""))


def reason_class(c) -> Column:
    """maintenance | other."""
    t = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(t.rlike("maintenance|overhaul|revision"), "maintenance").otherwise("other")


def outage_type_norm(c) -> Column:
    t = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.when(t == "unplanned", "forced").otherwise(t)


def outage_type_title(c) -> Column:
    t = outage_type_norm(c)
    return F.when(t.isin("planned", "forced"), F.initcap(t))


# Three different readings of a flag written as text. They disagree on purpose
# (a missing "old version" means current, a missing correction flag means no).
def is_false_like(c) -> Column:
    t = F.lower(F.trim(col(c).cast("string")))
    return t.isNull() | t.isin("", "false", "0", "no", "n")


def is_true_like(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def flag_with_default(c, default: bool = False) -> Column:
    t = F.lower(F.trim(col(c).cast("string")))
    return (
        F.when(t.isin("true", "t", "1", "yes", "y"), F.lit(True))
        .when(t.isin("false", "f", "0", "no", "n", "", "nan", "none", "null", "na", "n/a"), F.lit(False))
        .otherwise(F.lit(default))
    )


def area_type_matches(c, wanted: str) -> Column:
    want = wanted.strip().upper().replace("_", "/")
    t = F.regexp_replace(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), r"\s+", "")
    t = F.regexp_replace(t, "_", "/")
    accepted = [want] + (["BZN/CTA"] if want in ("BZN", "CTA") else [])
    return t.isin(*accepted)


def asset_bucket(c) -> Column:
    t = F.upper(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.when(t == "GENERATION", "generation").when(t == "PRODUCTION", "production").otherwise("others")


def id_suffix(c) -> Column:
    """Identifier part safe to append to a document id."""
    t = F.regexp_replace(F.upper(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))), "[^0-9A-Z]+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.when(t != "", t).otherwise("UNKNOWN_UNIT")


def unit_name_key(c) -> Column:
    """Lower-case alphanumeric words of a unit name, without a trailing kind word."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(t, r"(^| )(unit|block|gruppe|group|bloc|tranche)$", ""))


def compact_name_key(c) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def slug(c) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))), "[^a-z0-9]+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")
