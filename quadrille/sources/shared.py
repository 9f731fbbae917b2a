"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (a local session), a folder of our own."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{SETTING} has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder on any file system that Spark reads; False if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def made_folder(spark: SparkSession, path: str) -> str:
    """The folder, made if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return path
