"""Replace-style loading, and what the pipeline's ledgers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_children(old: DataFrame, processed: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Children of all ``processed`` parents give way to ``new``, also where there are no new ones; others stay."""
    return old.join(processed.select(key), key, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet come in."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def backfilled(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children without a workspace take their parent's."""
    own = parents.select(F.col("id").alias("document_id"), F.col("workspace_id").alias("_w"))
    return children.join(own, "document_id", "left").withColumn("workspace_id", F.coalesce("workspace_id", "_w")).drop("_w")


def backfilled_through(points: DataFrame, charts: DataFrame, parents: DataFrame) -> DataFrame:
    """Points (chart_id) without a workspace take that of their chart's document; charts are joined to documents first, being fewer."""
    owners = charts.select(F.col("id").alias("chart_id"), "document_id").join(parents.select(F.col("id").alias("document_id"), F.col("workspace_id").alias("_w")), "document_id").select("chart_id", "_w")
    return points.join(owners, "chart_id", "left").withColumn("workspace_id", F.coalesce("workspace_id", "_w")).drop("_w")


def first_copies(docs: DataFrame) -> DataFrame:
    """The first document of each content in each workspace (none is a workspace too); later ones are refused."""
    order = F.struct(F.col("created_at").isNull(), "created_at", "id")
    firsts = docs.groupBy("workspace_id", "file_hash").agg(F.min_by("id", order).alias("id"), F.count("*").alias("copies"))
    return firsts.select("id", "workspace_id", "file_hash", "copies")


def latest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key the values of the newest row, equal times by id; sums of partial results, no sort of a key's rows."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("created_at", "id")).alias("_v"))
    return newest.select(*keys, "_v.*")


def to_skip(docs: DataFrame, runs: DataFrame, purpose: str, force: bool = False) -> DataFrame:
    """Documents with ``skip``: the newest run for a purpose saw this very content. Rejected runs count too."""
    last = latest(runs.where(F.col("purpose") == purpose), ["document_id"], ["file_hash"]).withColumnsRenamed({"file_hash": "seen", "document_id": "id"})
    same = F.lit(not force) & F.col("file_hash").isNotNull() & (F.col("seen") == F.col("file_hash"))
    return docs.join(last, "id", "left").select("id", F.coalesce(same, F.lit(False)).alias("skip"))


#: What an event makes of a state (fixed values); every other pair is refused.
TRANSITIONS = {
    ("Processing", "failed"): "Failed", ("Processing", "ocr_failed"): "Needs Review", ("Processing", "insights"): "Ready",
    ("Needs Review", "approve"): "Ready", ("Needs Review", "reject"): "Failed", ("Needs Review", "reprocess"): "Processing",
}


def next_status(status: Column, event: Column) -> Column:
    """The state after an event; null where the event is refused."""
    out = F.lit(None).cast("string")
    for (was, what), then in TRANSITIONS.items():
        out = F.when((status == was) & (event == what), then).otherwise(out)
    return out


def bi_status(status: Column, classification: Column) -> Column:
    return F.when((status == "Ready") & (classification != "Restricted"), "synced").when(classification == "Restricted", "excluded").otherwise("not-synced")


#: Audit actions of new states (fixed values).
ACTIONS = {"Ready": "document.approved", "Rejected": "document.rejected", "Failed": "document.failed", "Needs Review": "document.needs_review"}


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose state or classification changed: the audit action, if the state has one, and the report state now."""
    was = old.select("id", F.col("status").alias("was"), F.col("classification").alias("_c"))
    both = new.select("id", "status", "classification").join(was, "id")
    moved, reclassified = ~F.col("status").eqNullSafe(F.col("was")), ~F.col("classification").eqNullSafe(F.col("_c"))
    action = F.lit(None).cast("string")
    for status, name in ACTIONS.items():
        action = F.when(F.col("status") == status, name).otherwise(action)
    return both.where(moved | reclassified).select("id", "was", "status", F.when(moved, action).alias("action"), bi_status(F.col("status"), F.col("classification")).alias("bi_status"))


def rate_limited(events: DataFrame, most: int, every: str = "1 hour") -> DataFrame:
    """Events per user and window of the clock: how many were let through and how many refused."""
    n = events.groupBy("user_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").alias("window_start"), F.least("n", F.lit(most)).cast("long").alias("allowed"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("refused"))


def activated(prompts: DataFrame, name: str, version: int) -> DataFrame:
    """One version of a prompt is active, its others are not."""
    return prompts.withColumn("active", F.when(F.col("name") == name, F.col("version") == version).otherwise(F.col("active")))


def ranked_first(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def chained(latest: DataFrame, stages: tuple[str, ...], good: tuple[str, ...] = ("completed", "skipped")) -> DataFrame:
    """``document_id, done, stopped_at, status``: stages that ended well before the first that did not, and that one."""
    at = F.map_from_entries(F.collect_list(F.struct("stage", "status")))
    every = latest.groupBy("document_id").agg(at.alias("at"))
    listed = F.transform(F.lit(list(stages)), lambda s: F.struct(s.alias("stage"), F.coalesce(F.try_element_at("at", s), F.lit("not_started")).alias("status")))
    stopped = F.filter(listed, lambda x: ~x["status"].isin(*good))
    first = F.get(stopped, F.lit(0))
    done = F.when(F.size(stopped) == 0, F.lit(len(stages))).otherwise(F.array_position(F.transform(listed, lambda x: x["stage"]), first["stage"]) - 1)
    return every.select("document_id", done.cast("int").alias("done"), first["stage"].alias("stopped_at"), first["status"].alias("status"))
