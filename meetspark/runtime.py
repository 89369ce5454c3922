"""Session-level helpers: reading tables and cutting lineage in a shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


_SHIPPED: set[str] = set()
#: application -> its folder for tables between stages.
_FOLDERS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, wherever it was imported from."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        path = os.path.join(tempfile.mkdtemp(prefix="meetspark-"), "meetspark.zip")
        with zipfile.PyZipFile(path, "w") as file:
            file.writepy(os.path.dirname(os.path.abspath(__file__)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset a temporary folder is made for the session, on a local
    master only; a cluster without a shared folder is refused. What was written
    there is deleted when Python ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        folder = f"{(named or tempfile.mkdtemp(prefix='meetspark-')).rstrip('/')}/meetspark-{context.applicationId}"
        _FOLDERS[context.applicationId] = folder
        atexit.register(_delete, spark, folder)
    return _FOLDERS[context.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies; nothing happens if the session has ended on a shared file system."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001
        if "://" not in path or path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder.

    Columnar files are much smaller than checkpoints for repetitive arrays and
    let later stages read single columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._meetspark_path = path
    return back


def settled(df: DataFrame, label: str) -> DataFrame:
    """As ``written``; then the driver lets go of what the steps so far have left.

    Plans of a step are many small objects, and the shuffle files of a step stay
    on disk until the driver collects its plan; left to itself it grows to its
    limit first.
    """
    back = written(df, label)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return back


def only(df: DataFrame, condition: str) -> DataFrame:
    """The rows for which ``condition`` holds, tested behind what made its columns; a filter would have the planner copy their expressions."""
    return df.withColumn("__only", F.explode(F.expr(f"CASE WHEN {condition} THEN array(true) END"))).drop("__only")


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing will read them any more."""
    for df in tables:
        _delete(df.sparkSession, df._meetspark_path)
