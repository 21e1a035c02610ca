"""Session helpers: the shared work folder and the package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a local folder,
    removed when the program ends; on a cluster this is an error.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="escalade-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_local_dir)
    return _local_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/escalade/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table written below the shared folder: made once, however often it is read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it does not exist."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(root) if f.isDirectory()) if system.exists(root) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing will read again."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # Only the driver reads the archive; Spark copies it to the executors.
    named = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file:")
    shared = Path(named) if named.startswith("/") and Path(named).is_dir() else None
    folder = tempfile.mkdtemp(prefix="escalade-package-", dir=shared)
    archive = shutil.make_archive(f"{folder}/escalade", "zip", root_dir=root.parent, base_dir=root.name)
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
