"""Where intermediate tables go: a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    """(file system, path) of a location, as the session resolves it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster sets it; a temporary folder only where all is one process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyworks.marts.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyworks-marts-")
        spark.conf.set("tallyworks.marts.dir", where)
    fs, p = path_of(spark, where)
    return fs.makeQualified(p).toString().rstrip("/")


def stamp(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of all files below a path, at any depth: what a cached result depends on. Folders
    have no say, as object stores keep no times for them."""
    fs, p = path_of(spark, path)
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)
