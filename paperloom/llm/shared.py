"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: blank and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a key that a task takes at most (about) in a salted join, and the most keys that are salted.
HOT_ROWS, HOT_KEYS = 1000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, local mode gets a temporary folder; a cluster has no folder that is known to be shared, so
    that is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables of one run in the shared folder: lineage ends at each, so lost executors cost no earlier stage.

    ``drop`` deletes tables that nothing will read any more. What a lazy result still reads stays with the folder.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._dir, self._paths = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._dir}/{name}-{len(self._paths)}"
        # a table is read by the run that wrote it, which needs no mark of success (on local disks the mark forks the driver)
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        table = self._spark.read.schema(df.schema).parquet(path)
        self._paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self._paths:
            if any(table is x for x in tables):
                at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    return Scratch(df.sparkSession).write(df, name)


class Salted:
    """Joins of ``rows`` with tables that have one row a key, where a few keys may hold most rows.

    ``counts`` has the keys and their number of rows ``m``. A key with more than ``HOT_ROWS`` rows (or a share of
    ``1 / HOT_KEYS`` of ``total``, if that is more) is hot: its rows go to several tasks, and the other side's row goes to each.
    There are at most ``HOT_KEYS`` hot keys, so their list fits the driver and all tasks whatever the data; mostly there
    are none, and the join is a plain one.
    """

    def __init__(self, counts: DataFrame, keys: list[str], total: int):
        limit = max(HOT_ROWS, -(-total // HOT_KEYS))
        self.keys, self.hot = keys, None
        if total > limit:
            # told by one number, whatever the key's columns: both sides deal out a key by the same number, and a relation
            # of single numbers is a small one in every task's memory
            hot = counts.where(F.col("m") > limit).select(F.xxhash64(*keys).alias("_hot"), F.ceil(F.col("m") / limit).cast("long").alias("_parts"))
            if found := hot.groupBy("_hot").agg(F.max("_parts").alias("_parts")).collect():
                self.hot = counts.sparkSession.createDataFrame(found, "_hot long, _parts long")

    def _parts(self, df: DataFrame) -> DataFrame:
        told = df.withColumn("_hot", F.xxhash64(*self.keys)).join(F.broadcast(self.hot), "_hot", "left").drop("_hot")
        return told.withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))

    def _table(self, df: DataFrame) -> DataFrame:
        return self._parts(df).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")

    def join(self, rows: DataFrame, by: str, *tables: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` with ``tables``; ``by`` names what the rows of a hot key are dealt by."""
        if self.hot is None:
            return reduce(lambda df, t: df.join(t, self.keys, how), tables, rows)
        salted = self._parts(rows).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_parts"))).drop("_parts")
        return reduce(lambda df, t: df.join(self._table(t), [*self.keys, "_salt"], how), tables, salted).drop("_salt")
