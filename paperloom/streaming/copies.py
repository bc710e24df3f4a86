"""First copies on a stream without a horizon: hashes are kept in a table, not in state that a watermark forgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


class FirstCopies:
    """Hashes met so far, at ``path``, in folders by micro-batch and by the hash's first two characters.

    For ``foreachBatch``: ``judge`` gives a batch's documents with ``accepted``. A batch that is repeated gets the same
    answers, as it doesn't look at what it wrote itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _keyed(self, docs: DataFrame) -> DataFrame:
        none = F.coalesce(F.concat(F.lit("="), F.col("workspace_id").cast("string")), F.lit("none"))
        return docs.withColumn("_w", none).withColumn("_p", F.concat(F.lit("h"), F.coalesce(F.substring("file_hash", 1, 2), F.lit(""))))

    def seen(self, before: int) -> DataFrame:
        """``prefix, _w, file_hash`` of all batches before one; a prefix's rows lie together."""
        batches = [x for x in store.children(self.spark, self.path) if x.startswith("batch=") and int(x[6:]) < before]
        schema = "_w string, file_hash string, prefix string, batch long"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{x}" for x in batches])

    def judge(self, docs: DataFrame, batch: int) -> DataFrame:
        """``docs`` (id, workspace_id, file_hash, created_at, ...) with ``accepted``: the first of its workspace and content, ever.

        Within a batch the earliest is first, then the smallest id. Documents without a hash are all accepted.
        """
        rows = self._keyed(docs)
        order = F.struct(F.col("created_at").isNull(), "created_at", "id")
        firsts = rows.where("file_hash IS NOT NULL").groupBy("_p", "_w", "file_hash").agg(F.min_by("id", order).alias("_first"))
        # two characters: some hundred prefixes at most; folders of others are not read
        prefixes = [r["_p"] for r in firsts.select("_p").distinct().collect()]
        met = self.seen(batch).where(F.col("prefix").isin(prefixes)).select(F.col("prefix").alias("_p"), "_w", "file_hash")
        new = firsts.join(met, ["_p", "_w", "file_hash"], "left_anti")
        new = new.withColumn("prefix", F.col("_p"))
        where = f"{self.path}/batch={batch}"
        new.select("_w", "file_hash", "prefix", "_first").repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(where)
        written = self.spark.read.schema("_w string, file_hash string, _first long, prefix string").parquet(where) if prefixes else self.spark.createDataFrame([], "_w string, file_hash string, _first long, prefix string")
        accepted = F.col("file_hash").isNull() | F.coalesce(F.col("_first") == F.col("id"), F.lit(False))
        return rows.join(written.drop("prefix"), ["_w", "file_hash"], "left").select(*docs.columns, accepted.alias("accepted"))
