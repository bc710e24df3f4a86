"""Reports that are kept up by what changed, instead of being made anew.

Changes are rows with a ``sign``: 1 for a row that came, -1 for one that went; a changed row is both. A report joined
from documents and their children changes by ``joined_changes``, which reads of each table only what meets a change of the
other. ``Report`` keeps the rows in parts by workspace and slot of documents: a batch writes the parts that it touches
anew, beside the old ones, and tells so in one step of the file system. Parts that it doesn't touch keep their files, a
batch that failed has told nothing, and one that comes again does nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

_TOLD = "part string, batch long, n long"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign).cast("long"))


def net(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with the sum of their signs; those that cancel out go. Nulls are equal."""
    columns = [c for c in rows.columns if c != "sign"]
    return rows.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What makes ``new`` of ``old``; both are read whole, for tables that keep no feed of their own."""
    return net(signed(old, -1).unionByName(signed(new, 1)))


def applied(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``rows`` after ``changed``. A row that goes more often than it is there is an error."""
    after = net(signed(rows, 1).unionByName(changed.select(*rows.columns, "sign")))
    times = F.when(F.col("sign") < 0, F.raise_error(F.lit("a row was to go that is not there")).cast("long")).otherwise(F.col("sign"))
    return after.select(*rows.columns, F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("_")).drop("_")


def joined_changes(docs: DataFrame, docs_changed: DataFrame, children: DataFrame, children_changed: DataFrame, key: str = "document_id") -> DataFrame:
    """How ``docs`` joined with ``children`` changes. ``docs`` and ``children`` are as they were before.

    Changed children meet the documents as they were, children old and changed meet the changed documents: three joins on
    the key, each with a side of changes.
    """
    out = [c for c in docs.columns if c != key], [c for c in children.columns if c != key]

    def met(d: DataFrame, c: DataFrame) -> DataFrame:
        both = d.withColumnRenamed("sign", "of_doc").join(c.withColumnRenamed("sign", "of_child"), key)
        return both.select(key, *out[0], *out[1], (F.col("of_doc") * F.col("of_child")).alias("sign"))

    parts = met(signed(docs, 1), children_changed), met(docs_changed, signed(children, 1)), met(docs_changed, children_changed)
    return net(parts[0].union(parts[1]).union(parts[2]))


class Report:
    """Rows of ``schema`` at ``path``, in parts by ``workspace`` and one of ``slots`` slots of ``key``.

    A large workspace is as many tasks as it has slots, and more where Spark splits a large part. The driver holds the
    list of parts (a row each), as it does for any partitioned table. Batches have rising numbers. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, workspace: str = "workspace_id", key: str = "document_id", slots: int = 16):
        self.spark, self.path, self.workspace, self.key, self.slots = spark, path, workspace, key, slots
        self.schema = spark.createDataFrame([], schema).schema

    def _space(self, workspace: Column) -> Column:
        return F.lower(F.hex(F.xxhash64(workspace.cast("string"))))

    def _part(self) -> Column:
        return F.concat_ws("-", self._space(F.col(self.workspace)), F.pmod(F.xxhash64(self.key), F.lit(self.slots)))

    def _told(self) -> DataFrame:
        """``part, batch, n``: the newest batch of each part, and its rows."""
        names = [x for x in store.children(self.spark, f"{self.path}/told") if x.startswith("batch-")]
        if not names:
            return self.spark.createDataFrame([], _TOLD)
        rows = self.spark.read.schema(_TOLD).json([f"{self.path}/told/{x}" for x in names])
        return rows.groupBy("part").agg(F.max_by(F.struct("batch", "n"), "batch").alias("x")).select("part", "x.*")

    def done(self, batch: int) -> bool:
        return store.exists(self.spark, f"{self.path}/told/batch-{batch}")

    def _rows(self, told: DataFrame) -> DataFrame:
        paths = [f"{self.path}/rows/batch={r.batch}/part={r.part}" for r in told.where("n > 0").collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, workspaces: list[str | None] | None = None) -> DataFrame:
        """The report, of some workspaces only if given; others' files are not opened."""
        told = self._told()
        if workspaces is None:
            return self._rows(told)
        asked = self.spark.createDataFrame([(w,) for w in workspaces], "w string")
        told = told.join(asked.select(self._space(F.col("w")).alias("space")).distinct(), F.substring_index("part", "-", 1) == F.col("space"), "left_semi")
        mine = asked.distinct().withColumnRenamed("w", "asked")
        return self._rows(told).join(F.broadcast(mine), F.col(self.workspace).eqNullSafe(F.col("asked")), "left_semi")

    def apply(self, batch: int, changed: DataFrame) -> None:
        """The report after rows with signs, as ``joined_changes`` gives them."""
        if self.done(batch):
            return
        columns = self.schema.names
        at = f"{self.path}/changes/batch={batch}"
        net(changed.select(*columns, "sign")).withColumn("part", self._part()).write.mode("overwrite").parquet(at)
        new = self.spark.read.parquet(at)
        touched = new.select("part").distinct()
        old = self._rows(self._told().join(touched, "part", "left_semi"))
        where = f"{self.path}/rows/batch={batch}"
        after = applied(old, new).withColumn("part", self._part())
        after.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(where)
        there = any(x.startswith("part=") for x in store.children(self.spark, where))
        counts = self.spark.read.parquet(where).select(F.col("part").cast("string")).groupBy("part").count() if there else self.spark.createDataFrame([], "part string, count long")
        told = touched.join(counts, "part", "left").select("part", F.lit(batch).cast("long").alias("batch"), F.coalesce("count", F.lit(0)).alias("n"))
        passing = f"{self.path}/passing-{uuid.uuid4().hex}"
        told.coalesce(1).write.json(passing)
        store.make(self.spark, f"{self.path}/told")
        store.rename(self.spark, passing, f"{self.path}/told/batch-{batch}")

    def sweep(self) -> None:
        """Deletes files of told batches that no reader of the report as it is now needs, and the changes that made them."""
        now = {(r.batch, r.part) for r in self._told().where("n > 0").collect()}
        for kind in ("rows", "changes"):
            for name in store.children(self.spark, f"{self.path}/{kind}"):
                batch = int(name.partition("=")[2])
                if not self.done(batch):
                    continue
                if kind == "changes":
                    store.drop(self.spark, f"{self.path}/{kind}/{name}")
                    continue
                for part in store.children(self.spark, f"{self.path}/rows/{name}"):
                    if part.startswith("part=") and (batch, part[5:]) not in now:
                        store.drop(self.spark, f"{self.path}/rows/{name}/{part}")
