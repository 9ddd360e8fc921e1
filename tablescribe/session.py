"""Session helpers: a local session for tests and benchmarks, and written intermediate tables."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_run_dirs: set[str] = set()
_scratch: list[list[str]] = []


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session with the settings the tests and ``bench.py`` use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tablescribe")
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``, or where that is not set a folder of the warehouse.

    On a cluster a warehouse on the machine's own disk is no shared folder, so there the setting is needed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and re.match(r"file:|/", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_work"


def run_dir(spark: SparkSession) -> str:
    """This application's own folder there. What it holds is deleted when the driver's Python ends."""
    path = f"{work_dir(spark)}/tablescribe/{spark.sparkContext.applicationId}"
    if path not in _run_dirs:
        _run_dirs.add(path)
        atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session still runs and the folder is there."""
    if spark.sparkContext._jsc is None:  # stopped before
        return
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as tasks need it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path in the shared folder."""
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written by :func:`materialize` in this block is deleted at its end; nothing may read it later."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.remove(paths)
        for path in paths:
            delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage, keeps column pruning and filter pushdown for later steps, and survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, columns: str | list[str], name: str) -> DataFrame:
    """As :func:`materialize`, dealt into buckets by ``columns``: what is joined or grouped by them reads the buckets without a shuffle.

    There are as many buckets as shuffle partitions. Rows are not moved for it, so each task should hold few values of
    ``columns``, or rows repartitioned by them into as many partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"tablescribe_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    df.write.bucketBy(buckets, [columns] if isinstance(columns, str) else columns).option("path", path).option("compression", "zstd").saveAsTable(table)
    atexit.register(_drop, spark, table)
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
