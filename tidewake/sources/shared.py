"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a new folder of this machine, which then must be the whole
    cluster: on any other, executors would write to their own disks, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidewake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared folder; it goes when the session's JVM ends, if the folder is there by then."""
    path = f"{shared_dir(spark)}/tidewake/{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.mkdirs(at.getParent())
    # An empty folder is marked for deletion, whatever is written into its place later.
    files.mkdirs(at)
    files.deleteOnExit(at)
    files.delete(at, True)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
