"""Folders that the driver and all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="scrollmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _at(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def version_of(spark: SparkSession, path: str) -> str:
    """A digest of a table's name and of the sizes and times of its files: another one as soon as it is written anew."""
    fs, at = _at(spark, path)
    files = fs.listFiles(at, True)
    told = [path]
    while files.hasNext():
        f = files.next()
        told.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join([told[0], *sorted(told[1:])]).encode()).hexdigest()


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: what uses it more than once neither works it out anew nor depends on lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """The table of that name in the shared folder; ``make()`` is written to it if it is not there, or was never completed."""
    path = f"{shared_dir(spark)}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df = make()
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return spark.read.parquet(path)
