"""Cutting lineage in the folder that the cluster shares, and folders for written tables in it."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs locally."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="latticework-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
        delete_at_end(spark, sc.getCheckpointDir())  # a folder of this application's own below it
    return where


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have Spark's own file system remove a folder when the application ends: lazy results may read it until then."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Have Spark's own file system remove a folder now."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark removes the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package, but for the training-data operators, to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    folder = Path(tempfile.mkdtemp(prefix="latticework-core-"))  # the driver serves it from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "latticework_core.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "latticework").rglob("*.py")):
            if "llm" not in p.relative_to(root).parts:
                z.write(p, str(p.relative_to(root)))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
