"""Tables that a job writes for later steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``; only a local master may do without that setting."""
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """One step of the file system: afterwards ``to`` is whole, or there was something there already."""
    fs, at = _file_system(spark, path)
    return fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to))


def kept(df: DataFrame, path: str, *by: str) -> DataFrame:
    """``df`` as a table at ``path``, in folders ``by`` the given columns."""
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def make(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
