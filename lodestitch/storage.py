"""The folder that all machines share: intermediate tables, and files of Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and everything runs in one
    process (tests), a temporary folder; on a cluster an unset folder is an error, since a
    machine's own folder can't be read by the others."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="lodestitch-")
        root = _LOCAL_ROOTS[app]
    return f"{root.rstrip('/')}/lodestitch-{app}"


def shared_path(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's Java classes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no later read needs."""
    for path in paths:
        fs, at = file_system(spark, path)
        fs.delete(at, True)


def replace(spark: SparkSession, staged: str, final: str) -> None:
    """Put a staged folder in a final one's place."""
    fs, to = file_system(spark, final)
    fs.delete(to, True)
    fs.mkdirs(to.getParent())
    if not fs.rename(file_system(spark, staged)[1], to):
        raise OSError(f"{staged} can't be moved to {final}")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: cuts the lineage, survives lost
    executors, and fixes what is computed once (row numbers of a scan, for example)."""
    spark = df.sparkSession
    path = path or shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
