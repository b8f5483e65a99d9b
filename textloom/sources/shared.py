"""The folder that all executors share, for tables that operators write on their way."""

from __future__ import annotations

import os
import tempfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the checkpoint directory that is set, else (local masters only)
    a folder made for this session."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="textloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{os.urandom(8).hex()}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once, into a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """For Python workers: the file system of a URI or local path, and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
