"""Folders that all executors share, for tables written and read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode,
    as in tests; on a cluster an error, since a machine's own folder is not shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lexsieve-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def app_dir(spark: SparkSession) -> str:
    """This application's folder in ``shared_dir``. It goes when the driver ends, as long as it isn't killed."""
    path = f"{shared_dir(spark)}/lexsieve-{spark.sparkContext.applicationId}"
    at, fs = _path(spark, path)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file."""
    at, fs = _path(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
