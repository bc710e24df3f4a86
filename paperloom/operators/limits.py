"""Rate limits whose bucket opens at a key's first hit and closes a fixed time later: a verdict for every hit.

A bucket opens at a hit that no bucket holds, so each start decides the next. Hits are dealt out by key and slice of time,
a slice being as long as a bucket: a slice holds one start at most, and only a slice's first hit can follow a pause that
makes it a start for certain. Every hit points at the first one that its own bucket wouldn't hold; starts are what the
pointers reach from those certain ones, found by doubling. So a key with most hits is as many groups as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

#: A bucket's seconds and hits, and how long a hit over the limit waits for the next bucket.
SECONDS, MOST, PATIENCE = 60, 40, 20


def _hits(events: DataFrame, width: int) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    rows = events.select(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("none")).alias("key"), at.alias("at"), "id").where("at IS NOT NULL")
    return rows.withColumn("slice", F.floor(F.col("at") / width).cast("long"))


def _slices(hits: DataFrame, width: int) -> DataFrame:
    """A row for each key and slice that has hits: its first hit, whether that is a certain start, and the first beyond the next slice."""
    found = hits.groupBy("key", "slice").agg(F.min(F.struct("at", "id")).alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("key").orderBy("slice")
    before, after, second = F.lag("last").over(order), F.lead(F.struct("slice", "first")).over(order), F.lead("first", 2).over(order)
    told = found.select("key", "slice", "first", before.alias("before"), after.alias("after"), second.alias("second"))
    certain = F.col("before").isNull() | (F.col("first.at") - F.col("before") >= width)
    beyond = F.when(F.col("after.slice") == F.col("slice") + 1, F.col("second")).otherwise(F.col("after.first"))
    return told.select("key", "slice", "first", certain.alias("certain"), beyond.alias("beyond"))


def _pointers(hits: DataFrame, slices: DataFrame, width: int) -> DataFrame:
    """``key, id, next``: the first hit that a bucket from this one doesn't hold; none where that is a certain start, or there is none."""
    ask = hits.join(slices.select("key", "slice", "beyond"), ["key", "slice"])
    asking = ask.select("key", (F.col("slice") + 1).alias("slice"), (F.col("at") + width).alias("at"), F.lit(0).alias("there"), "id", "beyond")
    there = hits.select("key", "slice", "at", F.lit(1).alias("there"), "id", F.lit(None).cast("struct<at:bigint,id:bigint>").alias("beyond"))
    # from late to early, so that the frame is a running one; the hits of an instant from high ids to low
    order = Window.partitionBy("key", "slice").orderBy(F.desc("at"), F.desc("there"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("there") == 1, F.struct("at", "id")), ignorenulls=True).over(order)
    found = there.unionByName(asking).withColumn("seen", seen).where("there = 0").select("key", "id", F.coalesce("seen", "beyond").alias("next"))
    certain = slices.where("certain").select("key", F.col("first.id").alias("stop"))
    kept = found.where("next IS NOT NULL").select("key", "id", F.col("next.id").alias("next"))
    return kept.join(certain, (kept.key == certain.key) & (kept.next == certain.stop), "left_anti")


def _starts(roots: DataFrame, pointers: DataFrame, path: str) -> DataFrame:
    """``key, id`` of all hits that the pointers reach from the certain starts, in as many rounds as the logarithm of the longest way."""
    jumps, k = [store.kept(pointers, f"{path}/jump-0")], 0
    while not roots.join(jumps[k], ["key", "id"], "left_semi").isEmpty():
        a = jumps[k]
        b = a.select("key", F.col("id").alias("next"), F.col("next").alias("then"))
        jumps.append(store.kept(a.join(b, ["key", "next"]).select("key", "id", F.col("then").alias("next")), f"{path}/jump-{k + 1}"))
        k += 1
    found = roots
    for k in range(len(jumps) - 2, -1, -1):
        more = found.join(jumps[k], ["key", "id"]).select("key", F.col("next").alias("id"))
        found = store.kept(found.unionByName(more), f"{path}/starts-{k}")
    return found


def verdicts(events: DataFrame, seconds: int = SECONDS, most: int = MOST, patience: int = PATIENCE) -> DataFrame:
    """``id, bucket_start, hit, verdict`` for each of ``events`` (id, key, ts) that has a time; ids are unique.

    ``hit`` counts the bucket's hits in order of time and id. The first ``most`` are ``allowed``; later ones are
    ``delayed`` where the bucket closes within ``patience`` seconds, else ``refused``. A hit in the very moment of closing
    opens the next bucket. A null key is a key of its own. What a delayed caller does next is a hit of its own.
    """
    width, spark = seconds * 1_000_000, events.sparkSession
    path = store.shared_folder(spark, "limits")
    hits = store.kept(_hits(events, width), f"{path}/hits")
    slices = store.kept(_slices(hits, width), f"{path}/slices")
    roots = slices.where("certain").select("key", F.col("first.id").alias("id"))
    starts = hits.join(_starts(roots, _pointers(hits, slices, width), path), ["key", "id"]).select("key", "slice", F.struct("at", "id").alias("start"))
    # a hit's bucket opened in its own slice or in the one before
    near = starts.select("key", "slice", F.col("start").alias("own")).join(starts.select("key", (F.col("slice") + 1).alias("slice"), F.col("start").alias("earlier")), ["key", "slice"], "full")
    placed = hits.join(near, ["key", "slice"]).withColumn("bucket", F.when(F.col("own") <= F.struct("at", "id"), F.col("own")).otherwise(F.col("earlier")))
    placed = placed.select("key", "slice", "at", "id", "bucket")
    in_slice = F.row_number().over(Window.partitionBy("key", "slice", "bucket").orderBy("at", "id"))
    sizes = placed.groupBy("key", "slice", "bucket").agg(F.count("*").alias("n")).select("key", (F.col("slice") + 1).alias("slice"), "bucket", "n")
    ranked = placed.withColumn("k", in_slice).join(sizes, ["key", "slice", "bucket"], "left").withColumn("hit", F.col("k") + F.coalesce("n", F.lit(0)))
    return ranked.select("id", F.timestamp_micros(F.col("bucket.at")).cast("timestamp_ntz").alias("bucket_start"), F.col("hit").cast("long").alias("hit"), judged(F.col("hit"), F.col("bucket.at") + width - F.col("at"), most, patience).alias("verdict"))


def judged(hit, left, most: int, patience: int):
    """The verdict from a hit's number and the microseconds until its bucket closes."""
    return F.when(hit <= most, "allowed").when(left <= patience * 1_000_000, "delayed").otherwise("refused")
