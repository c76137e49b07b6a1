"""File sources. Paths may be a list or ``;``-separated text; every read is distributed."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schema as sc
from ..functions import text
from ..operators.capacity import active_intervals, conform_capacity
from ..operators.generation import unit_hour_means

CORRUPT = "_corrupt"


def paths(value: str | list[str]) -> list[str]:
    items = [value] if isinstance(value, str) else list(value)
    return [p.strip() for v in items for p in v.split(";") if p.strip()]


def asset_type_of_path(path: Column) -> Column:
    """Asset level named by a folder of the older exports."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return (
        F.when(p.contains("productionandgenerationunits"), F.lit(None).cast("string"))
        .when(p.contains("productionunits"), "PRODUCTION").when(p.contains("generationunits"), "GENERATION")
    )


MONTH_IN_NAME = re.compile(r"(\d{4})_(\d{2})[^/]*$")


def in_months(path: str, start: str | None, end: str | None) -> bool:
    """Whether a file may hold rows of [start, end): files name their month as YYYY_MM; those that
    name none may."""
    said = MONTH_IN_NAME.search(path)
    month = f"{said[1]}-{said[2]}" if said else None
    return month is None or not ((start and month < start[:7]) or (end and month > end[:7]))


def header_of(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names from the first line of a file, opened by its own file system (packed files
    too); no Spark job and no inference over the data."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
    try:
        first = lines.readLine()
    finally:
        lines.close()
    return next(csv.reader([(first or "").removeprefix("\ufeff")], delimiter=sep), [])


def read_text_table(spark: SparkSession, where: str | list[str], sep: str = "\t", wanted: set[str] | None = None,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """Delimited files with header, all columns as text, by name across files.

    Lines that do not fit with quoting on are read again with quoting off; only those
    lines go through the second parser. With ``start`` and ``end`` files of other months are
    left out by their names, before any of them is opened.
    """
    out = None
    for group in files_by_header(spark, paths(where), sep, start, end):
        part = _read_one(spark, group, sep)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no file of {start} to {end} in {where}")
    if wanted:
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c in wanted or c == "source_path"])
    return out


def files_by_header(spark: SparkSession, where: list[str], sep: str, start: str | None = None, end: str | None = None) -> list[list[str]]:
    """The catalogue of the given files and folders: those with one header line together, since old
    and new spellings may lie side by side and each file is read by its own names.

    Spark lists the folders once; of each file of the wanted months only the first line is
    read, by a few threads and without a job.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).select("path")
    names = [r["path"] for r in files.collect() if in_months(r["path"], start, end)]  # one name a file
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: tuple(header_of(spark, p, sep)), names))
    groups: dict[tuple[str, ...], list[str]] = {}
    for h, p in zip(headers, names):
        groups.setdefault(h, []).append(p)
    return [sorted(g) for _, g in sorted(groups.items())]


def _read_one(spark: SparkSession, path: list[str], sep: str) -> DataFrame:
    """Files that share a header, in one scan: a line that does not fit is parsed again, in
    place, with quoting off."""
    names = header_of(spark, path[0], sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
        .option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    ).withColumn("source_path", F.col("_metadata.file_path"))
    plain = F.from_csv(F.col(CORRUPT), ", ".join(f"`{n}` STRING" for n in names), {"sep": sep, "quote": "", "mode": "PERMISSIVE"})
    d = raw.withColumn("_again", F.when(F.col(CORRUPT).isNotNull(), plain))
    value = lambda n: F.when(F.col(CORRUPT).isNotNull(), F.col("_again").getField(n)).otherwise(F.col(f"`{n}`")).alias(n)
    return d.select(*[value(n) for n in names], "source_path")


def read_reports(spark: SparkSession, where: str | list[str], asset_types: set[str] | None = None, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """Raw outage reports, conformed; the asset level falls back to the folder name. With ``start``
    and ``end`` month files outside are not opened."""
    raw = read_text_table(spark, where, start=start, end=end)
    df = sc.conform(raw, sc.OUTAGE_REPORT, keep=["source_path"])
    df = df.withColumn("asset_type", F.upper(F.coalesce("asset_type", asset_type_of_path(F.col("source_path")))))
    df = df.withColumn("unit_name", F.coalesce("unit_name", "unit_eic")).withColumn("unit_eic", F.coalesce("unit_eic", "unit_name"))
    return df.filter(F.col("asset_type").isin(*asset_types)) if asset_types else df


def read_candidates(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """Raw reports for the candidate search: normalised status, type, reason and plant type."""
    from ..functions import codes

    d = read_reports(spark, where)
    return (
        d.withColumn("status_norm", F.lower(F.trim("status"))).withColumn("plant_type_code", codes.plant_type_code("plant_type"))
        .withColumn("start_derate", F.coalesce("start_derate", "start_out")).withColumn("end_derate", F.coalesce("end_derate", "end_out"))
        .withColumn("outage_type", text.outage_type_norm("outage_type")).withColumn("reason_class", text.reason_class("reason"))
        .withColumn("source_file", F.regexp_extract("source_path", "([^/]+)$", 1))
    )


def read_unit_capacity(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """Installed-capacity table as active intervals."""
    return active_intervals(conform_capacity(sc.conform(read_text_table(spark, where), sc.UNIT_CAPACITY)))


def sniff_separator(spark: SparkSession, path: str, candidates: str = ";\t,") -> str:
    """Separator that occurs most often in the first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(candidates, key=line.count)


def read_register(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    return sc.conform(read_text_table(spark, path, sniff_separator(spark, path)), spec)


def read_w_codes(spark: SparkSession, path: str) -> DataFrame:
    d = read_register(spark, path, sc.EIC_W)
    return d.dropDuplicates(["eic_code", "eic_parent"])


def read_y_areas(spark: SparkSession, path: str) -> DataFrame:
    """Area directory with its functions as flags."""
    d = read_register(spark, path, sc.EIC_Y)
    f = F.lower(F.coalesce("area_type_functions", F.lit("")))
    has = lambda w: f.rlike(rf"\b{w}\b")
    return d.withColumns({"is_bidding_zone": has("bidding zone"), "is_control_area": has("control area"), "is_scheduling_area": has("scheduling area")})


def read_plant_map(spark: SparkSession, path: str) -> DataFrame:
    return read_register(spark, path, sc.PLANT_MAP)


def read_panel(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Panel written by ``write_panel``: area and plant type come from the folders, and
    month, area and type filters prune files."""
    d = spark.read.parquet(root)
    if start:
        d = d.filter((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("month") >= F.lit(start[:7])))
    if end:
        d = d.filter((F.col("timestamp") < F.lit(end).cast("timestamp")) & (F.col("month") <= F.lit(end[:7])))
    return d.select(*columns) if columns else d


def read_generation_csv(spark: SparkSession, where: str | list[str], start: str, end: str, units: DataFrame | None = None,
                        areas: list[str] | None = None) -> DataFrame:
    """Raw metered generation to unit-hour means; files of other months are skipped by name."""
    raw = read_text_table(spark, where, start=start, end=end)
    return unit_hour_means(sc.conform(raw, sc.UNIT_GENERATION), start, end, units, areas)


def read_generation_parquet(spark: SparkSession, where: str | list[str], start: str, end: str, units: DataFrame | None = None) -> DataFrame:
    """Generation tables in either spelling; time filters are pushed to the files."""
    d = spark.read.option("mergeSchema", True).parquet(*paths(where))
    inside = F.lit(False)
    for at in [c for c in ("timestamp", "DateTime (UTC)", "DateTime(UTC)") if c in d.columns]:  # each file has one of them
        inside = inside | ((F.col(f"`{at}`") >= F.lit(start).cast("timestamp")) & (F.col(f"`{at}`") < F.lit(end).cast("timestamp")))
    d = d.filter(inside)
    return unit_hour_means(sc.conform(d, sc.UNIT_GENERATION), start, end, units)


def read_masks(spark: SparkSession, root: str, areas: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Correction masks; the partition columns prune folders."""
    d = spark.read.option("mergeSchema", True).parquet(root)
    if areas:
        d = d.filter(F.col("area").isin(*areas))
    return d.filter(F.col("plant_type_code").isin(*types)) if types else d


def read_labelled(spark: SparkSession, items: dict[str, str]) -> DataFrame:
    """Result tables ``{source: path}`` as one table with a ``source`` column."""
    out = None
    for source, path in items.items():
        d = read_text_table(spark, path, sniff_separator(spark, path)).drop("source_path").withColumn("source", F.lit(source))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_violations(spark: SparkSession, path: str, countries: list[str] | None = None) -> DataFrame:
    """Existing violation hours; the country may stand in any of three columns."""
    d = read_text_table(spark, path, sniff_separator(spark, path))
    if not countries:
        return d
    cond = F.lit(False)
    for c in ("country", "biddingzone", "generation_area_code"):
        if c in d.columns:
            cond = cond | F.coalesce(F.split_part(F.col(c), F.lit("_"), F.lit(1)).isin(*countries), F.lit(False))
    return d.filter(cond)


def legacy_daily(df: DataFrame, value: str) -> DataFrame:
    """Older aggregate sources: mean per zone and day, then sum per country and day."""
    zone = df.groupBy("country", "zone", "plant_type", F.to_date("timestamp").alias("date")).agg(F.avg(value).alias(value))
    return zone.groupBy("country", "plant_type", "date").agg(F.sum(value).alias(value))


def legacy_difference(new_daily: DataFrame, old_daily: DataFrame, value: str) -> DataFrame:
    keys = ["country", "plant_type", "date"]
    d = new_daily.select(*keys, F.col(value).alias(f"{value}_new")).join(old_daily.select(*keys, F.col(value).alias(f"{value}_old")), keys, "full")
    return d.withColumn(f"{value}_diff", F.col(f"{value}_new") - F.col(f"{value}_old"))
