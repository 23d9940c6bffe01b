"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; set to a local folder only where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext.getCheckpointDir()
        root = found or "file://" + tempfile.mkdtemp(prefix="scrollmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again: later uses neither recompute it nor depend on lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Remove what ``settle`` has written, when nothing reads it any more."""
    for df in settled:
        drop(df.sparkSession, df.settled_at)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that are settled: it does so when the driver's garbage is collected, which may be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that this module has made."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"not in the shared folder: {path}")
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def free_name(name: str, *taken: list[str]) -> str:
    """A column name that no table has, whatever the case of its letters."""
    used = {c.lower() for cols in taken for c in cols}
    while name.lower() in used:
        name += "_"
    return name


#: Rows that go to a Python worker at once; texts may be long, and both sides hold a batch several times.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives freed memory back at its end: Python workers live on, beside those of later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied
