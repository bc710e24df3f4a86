"""The pipeline's queries that make sense on a stream: first copies and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_copies(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Documents (workspace_id, file_hash, created_at) without those of a workspace and content met within the watermark."""
    none = F.coalesce(F.concat(F.lit("="), "workspace_id"), F.lit("none"))
    return docs.withColumn("_w", none).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["_w", "file_hash"]).drop("_w")


def rate_limited(events: DataFrame, most: int, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per user and window of the clock: let through and refused. Windows are final when the watermark passes."""
    n = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.least("n", F.lit(most)).cast("long").alias("allowed"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("refused"))
