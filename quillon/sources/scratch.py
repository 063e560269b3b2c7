"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session whose executors run inside the driver (master local[...], as in tests) gets a folder
    of its own, removed at exit; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_quillon_scratch"):
        spark._quillon_scratch = tempfile.mkdtemp(prefix="quillon")
        atexit.register(shutil.rmtree, spark._quillon_scratch, ignore_errors=True)
    return spark._quillon_scratch


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillon-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: what is computed from it twice sees the same rows, whatever
    executors are lost meanwhile."""
    path = new_path(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own type: local, remote or object store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it (case does not count)."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        out.append(name)
    return out
