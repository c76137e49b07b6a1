"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..schema import PANEL_COLUMNS


def write_panel(hours: DataFrame, root: str, mode: str = "overwrite", splits: int = 8) -> None:
    """Hourly panel partitioned by area, plant type and month, sorted by time and unit.

    Rows are spread by (area, type, month, unit hash), so a large area or a single busy
    type is written by ``splits`` tasks.
    """
    cols = [c for c in PANEL_COLUMNS if c in hours.columns]
    d = hours.select(*cols, F.date_format("timestamp", "yyyy-MM").alias("month"))
    d = d.repartition("area", "plant_type_code", "month", F.pmod(F.hash("eic_code"), F.lit(splits)))
    d.sortWithinPartitions("area", "plant_type_code", "month", "timestamp", "eic_code").write.mode(mode).partitionBy(
        "area", "plant_type_code", "month").parquet(root)


def write_sums(sums: DataFrame, root: str, mode: str = "overwrite") -> None:
    sums.repartition("area", "plant_type_code").sortWithinPartitions("area", "plant_type_code", "timestamp").write.mode(mode).partitionBy(
        "area", "plant_type_code").parquet(root)


def write_table(df: DataFrame, path: str, sep: str = ";", decimals: int | None = None, mode: str = "overwrite") -> None:
    """Delimited table; ``decimals`` fixes the number format of doubles."""
    if decimals is not None:
        df = df.select(*[F.format_string(f"%.{decimals}f", f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> bool:
    """Diagnostic table; returns whether it has rows. Rows are counted while they are written,
    and a table without rows is removed, an earlier one at that place too."""
    df, seen = counted(df, "report rows")
    write_table(df, path)
    if seen.get["rows"]:
        return True
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return False


def write_masks(mask: DataFrame, root: str, mode: str = "overwrite") -> DataFrame:
    """Correction masks per area, asset level and plant type; returns their index table."""
    from ..operators.inverse import mask_index

    mask.write.mode(mode).partitionBy("area", "asset_type", "plant_type_code").parquet(root)
    return mask_index(mask.sparkSession.read.parquet(root))


def write_bundle(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while they are written, without a second pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o


def run_metadata(spark, values: dict[str, object]) -> DataFrame:
    """Key/value table of options and counters."""
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
