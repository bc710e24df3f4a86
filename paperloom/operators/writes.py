"""Children that are replaced by whole documents, as a write: old or new ones are there at any time, never both or neither.

Children lie in buckets by document. A batch writes the buckets that it touches anew, beside the old ones, and then says
so in one step of the file system; readers take of each bucket the newest batch that was said. A batch that failed has
said nothing, and one that is repeated writes the same buckets again or, if it was said before, nothing. Buckets that a
batch doesn't touch keep their files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


class Children:
    """A table of children (``schema``, with the parent's ``key``) at ``path``, in ``buckets`` buckets.

    Batches have rising numbers, as those of ``foreachBatch`` do. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "document_id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _said(self) -> DataFrame:
        """``bucket, batch, n``: the newest batch of each bucket, and its rows; a row a bucket."""
        names = [x for x in store.children(self.spark, f"{self.path}/said") if x.startswith("batch-")]
        if not names:
            return self.spark.createDataFrame([], "bucket int, batch long, n long")
        rows = self.spark.read.schema("bucket int, batch long, n long").json([f"{self.path}/said/{x}" for x in names])
        return rows.groupBy("bucket").agg(F.max_by(F.struct("batch", "n"), "batch").alias("x")).select("bucket", "x.*")

    def done(self, batch: int) -> bool:
        return store.exists(self.spark, f"{self.path}/said/batch-{batch}")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The children, of some buckets only if given; others' files are not opened."""
        now = [r for r in self._said().collect() if r.n and (buckets is None or r.bucket in set(buckets))]
        empty = self.spark.createDataFrame([], self.schema)
        if not now:
            return empty
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.path}/rows/batch={r.batch}/bucket={r.bucket}" for r in now])

    def replace(self, batch: int, processed: DataFrame, new: DataFrame) -> None:
        """Children of all ``processed`` parents (key) give way to ``new``, also where there are no new ones."""
        if self.done(batch):
            return
        parents = processed.select(self.key).distinct()
        touched = sorted(r.b for r in parents.select(self._bucket().alias("b")).distinct().collect())  # buckets at most
        if not touched:
            return
        kept = self.read(touched).join(parents, self.key, "left_anti")
        rows = kept.unionByName(new.select(*kept.columns)).withColumn("bucket", self._bucket())
        where = f"{self.path}/rows/batch={batch}"
        rows.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
        there = any(x.startswith("bucket=") for x in store.children(self.spark, where))
        counts = {r.bucket: r["count"] for r in self.spark.read.parquet(where).groupBy("bucket").count().collect()} if there else {}
        said = self.spark.createDataFrame([(b, batch, counts.get(b, 0)) for b in touched], "bucket int, batch long, n long")
        passing = f"{self.path}/passing-{uuid.uuid4().hex}"
        said.coalesce(1).write.json(passing)
        store.make(self.spark, f"{self.path}/said")
        store.rename(self.spark, passing, f"{self.path}/said/batch-{batch}")

    def sweep(self) -> None:
        """Deletes what no reader of the table as it is now needs; not while an older reading goes on."""
        now = {(r.batch, r.bucket) for r in self._said().collect() if r.n}
        for name in store.children(self.spark, f"{self.path}/rows"):
            batch = int(name.partition("=")[2]) if name.startswith("batch=") else None
            for part in store.children(self.spark, f"{self.path}/rows/{name}"):
                if batch is not None and part.startswith("bucket=") and self.done(batch) and (batch, int(part[7:])) not in now:
                    store.drop(self.spark, f"{self.path}/rows/{name}/{part}")
