"""What the operators share: shipping this package to executors and cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import textward

_shipped: set[str] = set()


#: Rows and bytes of what goes to a Python worker at a time, so that its memory and the JVM's buffers don't follow the length of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would, and bound the session's Arrow batches."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(textward.__file__)))
    if os.path.isdir(os.path.join(root, "textward")):
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "textward_py"), "zip", root, "textward"))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or one of our own where that is unset and everything runs in one process."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="textward-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lost executors cost nothing before this point."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textward-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        if path.getName().startswith("textward-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[tuple[str, Hashable], object] = {}


def kept(operator: str, key: Hashable, make: Callable[[], object]):
    """What a worker keeps from task to task: one object. Those of other operators, or of other parameters, go first and their memory goes back to the system."""
    if (operator, key) not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _kept[operator, key] = make()
    return _kept[operator, key]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about `most`."""
    begin, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
