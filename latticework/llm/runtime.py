"""Shared helpers: lineage cutting in the cluster's shared folder, safe column handling."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) is a temporary folder
    chosen, and then the setting is filled in.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        where = sc.getCheckpointDir()
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="latticework-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    own = sc.getCheckpointDir()  # a folder of this application's own below it
    if own and own not in _LEAVING:
        _LEAVING.add(own)
        delete_at_end(spark, own)
    return where


_LEAVING: set[str] = set()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have Spark's own file system remove a folder when the application ends: lazy results may read it until then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).deleteOnExit(folder)


#: Seconds between the driver's collections, at least.
GC_SECONDS = 2.0
_LET_GO = 0.0


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark removes shuffle and checkpoint files of finished steps.

    Jobs of many steps would keep the files of all of them until the driver
    happens to run short of memory.  Short steps share one collection.
    """
    global _LET_GO
    if time.monotonic() - _LET_GO < GC_SECONDS:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _LET_GO = time.monotonic()


def cut(df: DataFrame, collect: bool = True) -> DataFrame:
    """Materialise ``df`` with checkpoint() so that later stages restart from shared files; ``collect``: see let_go()."""
    shared_dir(df.sparkSession)
    if collect:
        let_go(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it back.

    Used where the rows hold texts: Parquet is several times smaller than a
    checkpoint's serialised rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch where the session has Spark's default: rows here hold whole texts.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may not have it on their path, once for each application; set batches of texts."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    folder = Path(tempfile.mkdtemp(prefix="latticework-code-"))  # the driver serves it from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "latticework.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "latticework").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; also makes sure that the executors have this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    """Null texts count as empty ones."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
