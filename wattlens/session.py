"""Session settings the library relies on."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "wattlens", **conf) -> SparkSession:
    """Session with UTC timestamps, AQE and skew handling switched on.

    On a cluster leave ``master`` unset; shuffle partitions then come from the
    cluster's own configuration and AQE coalesces or splits them.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """All timestamps in this library are UTC; make a foreign session agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one named by ``spark.checkpoint.dir``, else one in
    the session's warehouse, which driver and executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system of ``path`` delete it when the driver ends."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


_written: list[dict[str, DataFrame]] = []  # tables by path, for each call of ``settled`` under way


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs.

    It does so when the driver's collector meets their plans, which a driver with little to
    do puts off for half an hour.
    """
    sc = spark.sparkContext
    gc.collect()  # frames that Python still holds keep their plans, as do events on their way
    spark.sql("SELECT 1").collect()  # and the last event that each listener has seen
    try:
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JJavaError:
        pass  # then these files wait for the next call
    sc._jvm.System.gc()


def store(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where a result feeds several branches: it is computed once, lost executors
    re-read it, and later branches scan only the columns they need. The table goes when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wattlens/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    if _written:
        _written[-1][path] = out
    return out


def materialise(df: DataFrame) -> DataFrame:
    """``store`` in the smallest form; the shuffle files of the write go at once, and the table
    when the ``settled`` around it is through."""
    out = store(df, compression="zstd")
    free_shuffles(df.sparkSession)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table of what ``make`` returns; tables that ``make`` wrote on the way there go."""
    _written.append({})
    try:
        out = make()
        if not any(out is t for t in _written[-1].values()):
            out = materialise(out)
    finally:
        tables = _written.pop()
    sc = out.sparkSession.sparkContext
    for path, t in tables.items():
        if t is not out:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return out
