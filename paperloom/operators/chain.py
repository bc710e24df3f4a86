"""An ordered chain of stages over documents, with a gate after each and durable marks.

A stage sees the documents that all stages before it let through, and says of each what went wrong, if anything. What it
returns is written aside and put in its place in one step: a stage whose table is there has ended, so a run that was
killed goes on with the first that has not. Documents that failed go no further; their errors stay with their stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store

Stage = Callable[[DataFrame], DataFrame]


def run(docs: DataFrame, stages: list[tuple[str, Stage]], folder: str) -> DataFrame:
    """``id, done, stopped_at, error`` for each of ``docs``: the stages that it passed, and the one that stopped it, if one did.

    A stage takes the columns of ``docs`` and returns them, changed or not, and ``error``, null where all went well.
    ``folder`` names one run over one input; a second call with it resumes.
    """
    spark, live, ended = docs.sparkSession, docs, []
    for k, (name, stage) in enumerate(stages):
        path = f"{folder}/{k:03d}-{name}"
        if not store.exists(spark, path):
            passing = f"{folder}/passing-{uuid.uuid4().hex}"
            stage(live).select(*docs.columns, F.col("error").cast("string").alias("error")).write.parquet(passing)
            store.rename(spark, passing, path)
        table = spark.read.schema(docs.limit(0).withColumn("error", F.lit(None).cast("string")).schema).parquet(path)
        ended.append(table.where("error IS NOT NULL").select("id", F.lit(k).alias("done"), F.lit(name).alias("stopped_at"), "error"))
        live = table.where("error IS NULL").drop("error")
    passed = live.select("id", F.lit(len(stages)).alias("done"), F.lit(None).cast("string").alias("stopped_at"), F.lit(None).cast("string").alias("error"))
    return reduce(DataFrame.unionByName, ended, passed)


def passed(spark, stages: list[tuple[str, Stage]], folder: str) -> DataFrame:
    """The documents that the last stage let through."""
    return spark.read.parquet(f"{folder}/{len(stages) - 1:03d}-{stages[-1][0]}").where("error IS NULL").drop("error")
