"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's. Where neither is set, a folder of our own, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new name in that folder, for files that go when the application ends."""
    path = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    where, files = file_system(spark, path)
    files.deleteOnExit(where)
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path, and Hadoop's file system that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
