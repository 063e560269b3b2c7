"""Reading tables, cutting lineage in the shared folder, and connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(out.select(*columns)) if columns else out


def shared(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a session whose executors run inside the driver
    (master local[...], as in tests) gets a folder of its own, removed at exit; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_quillon_dir"):
        spark._quillon_dir = tempfile.mkdtemp(prefix="quillon")
        atexit.register(shutil.rmtree, spark._quillon_dir, ignore_errors=True)
    return spark._quillon_dir


def stash(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: its lineage is cut, and a lost executor loses nothing.
    The file stays until discard(), or until the folder goes."""
    path = f"{shared(df.sparkSession)}/quillon-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the file of a stashed frame that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stashed)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it (case does not count)."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        out.append(name)
    return out


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node that can be reached.

    Large-star and small-star rounds: each halves the depth of the trees, so the rounds grow with the logarithm of a
    component's diameter, and no node's neighbours are ever gathered in one row. No edges give no rows."""
    links = stash(edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(limit):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        old, links = links, stash(small)
        discard(old)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
