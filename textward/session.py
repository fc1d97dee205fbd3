"""Session defaults and table access."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

import textward

_shipped: set[str] = set()


def local_session(cores: int = 8, app: str = "textward") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter configures its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; in one of our own where that is unset and everything runs in one process."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="textward-")
        sc.setCheckpointDir(where)
    return f"{where.rstrip('/')}/textward-{label}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete what shared_folder() named, once nothing reads it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would, for what runs in Python workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(textward.__file__)))
        if os.path.isdir(os.path.join(root, "textward")):
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "textward_core"), "zip", root, "textward"))
        _shipped.add(sc.applicationId)
