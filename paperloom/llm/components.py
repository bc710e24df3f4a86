"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Salted, Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(near: DataFrame, larger: bool, total: int) -> DataFrame:
    """Ties every node's (larger, or else smaller) neighbours to the least node among them and itself."""
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count("*").alias("m"))
    # the centre of a large star has its edges dealt out to several tasks
    tied = Salted(least.select("u", "m"), ["u"], total).join(near, "v", least.select("u", F.col("least").alias("m")))
    if larger:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``id, component`` (its smallest id) for all ids in ``links`` (columns ``a``, ``b``), as a table of ``scratch``.

    Every round writes its edges to the shared folder and deletes those of the round before; rounds end when a round
    changes nothing, after a number that grows with the logarithm of the component sizes. Nothing but two numbers a
    round comes to the driver.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        total, old = 2 * before[0], edges
        edges = scratch.write(_star(_star(_both(edges), True, total).select("u", "v"), False, total), "edges")
        scratch.drop(old)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = scratch.write(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots), "components")
    scratch.drop(edges)
    return found
