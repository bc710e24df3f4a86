"""What ordered histories say: the state after all events, runs from starts and ends, changes between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from .load import ACTIONS, TRANSITIONS, bi_status

STATES = ("Processing", "Needs Review", "Ready", "Failed")
#: Events of a range at most (about), in the scan over histories.
RANGE_ROWS = 100_000


def _after(state: Column, event: Column) -> Column:
    """The state's number after an event; itself where the event is refused."""
    table = [F.lit(x) for (was, what), then in TRANSITIONS.items() for x in (f"{STATES.index(was)}{what}", STATES.index(then))]
    return F.try_element_at(F.create_map(*table), F.concat(state.cast("string"), event))


def final_states(events: DataFrame, first: str = "Processing", rows: int = RANGE_ROWS) -> DataFrame:
    """``document_id, events, status, refused, first_refused`` over ``events`` (document_id, at, id, event).

    Events follow each other by time and id; a refused one leaves the state as it is, ``first_refused`` is the first such
    id. An event is a map of states to states, and maps compose: events are sorted into ranges of about ``rows`` across
    documents, each range composes its own for every state that it may be entered in, and a document's ranges are folded
    in order. So a document of a million events is many tasks, and its last fold sees a row a range. Null events are
    refused.
    """
    spark = events.sparkSession
    path = store.shared_folder(spark, "history")
    table = store.kept(events.select("document_id", "at", "id", F.coalesce("event", F.lit("")).alias("event")), f"{path}/events")
    ranges = max(1, -(-table.count() // rows))
    # ranges are written, so that they stay the same ones when a task is run again
    sorted_ = table.repartitionByRange(ranges, "document_id", "at", "id").withColumn("range", F.spark_partition_id())
    sorted_ = store.kept(sorted_, f"{path}/ranges")
    own = F.sort_array(F.collect_list(F.struct("at", "id", "event"))).alias("list")
    entered = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(0).cast("long").alias("refused"), F.lit(None).cast("long").alias("first")) for s in range(len(STATES))])

    def step(ways: Column, e: Column) -> Column:
        def one(w: Column) -> Column:
            to = _after(w["state"], e["event"])
            return F.struct(F.coalesce(to, w["state"]).alias("state"), (w["refused"] + F.when(to.isNull(), 1).otherwise(0)).cast("long").alias("refused"), F.coalesce(w["first"], F.when(to.isNull(), e["id"])).alias("first"))

        return F.transform(ways, one)

    composed = sorted_.groupBy("document_id", "range").agg(own, F.count("*").alias("n")).select("document_id", "range", "n", F.aggregate("list", entered, step).alias("ways"))
    chain = composed.groupBy("document_id").agg(F.sum("n").alias("events"), F.sort_array(F.collect_list(F.struct("range", "ways"))).alias("chain"))
    start = F.struct(F.lit(STATES.index(first)).alias("state"), F.lit(0).cast("long").alias("refused"), F.lit(None).cast("long").alias("first"))

    def follow(at: Column, r: Column) -> Column:
        way = F.element_at(r["ways"], at["state"] + 1)
        return F.struct(way["state"].alias("state"), (at["refused"] + way["refused"]).alias("refused"), F.coalesce(at["first"], way["first"]).alias("first"))

    end = chain.withColumn("end", F.aggregate("chain", start, follow))
    status = F.element_at(F.array(*map(F.lit, STATES)), F.col("end.state") + 1)
    return end.select("document_id", "events", status.alias("status"), F.col("end.refused").alias("refused"), F.col("end.first").alias("first_refused"))


def stage_runs(ledger: DataFrame) -> DataFrame:
    """``document_id, stage, attempt, status, started_at, ended_at, microseconds`` from ``ledger`` (id, document_id, stage, status, created_at).

    ``processing`` entries start a run, ``completed`` and ``failed`` ones end the run that was started last and has no end
    yet, ``skipped`` ones are runs of no length between others. A start that another start follows is ``orphaned``, one that
    nothing follows ``open``, and an end that no start belongs to ``unstarted``. Attempts count the starts so far.
    Entries of other or no status are not runs.
    """
    of = Window.partitionBy("document_id", "stage").orderBy("created_at", "id")
    skip, begins = F.col("status") == "skipped", F.col("status") == "processing"
    # skips stand between entries without parting them
    apart = Window.partitionBy("document_id", "stage", skip).orderBy("created_at", "id")
    entry = F.struct("status", "created_at")
    known = ledger.where(F.col("status").isin("processing", "completed", "failed", "skipped"))
    rows = known.select("document_id", "stage", "status", "created_at", F.lead(entry).over(apart).alias("then"), F.lag("status").over(apart).alias("was"), F.sum(begins.cast("int")).over(of.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("attempt"))
    ended = begins & F.col("then.status").isin("completed", "failed")
    status = F.when(skip, "skipped").when(begins & F.col("then").isNull(), "open").when(begins & ~ended, "orphaned").when(begins, F.col("then.status")).otherwise("unstarted")
    kept = rows.where(skip | begins | F.coalesce(F.col("was") != "processing", F.lit(True)))
    started = F.when(skip | begins, F.col("created_at"))
    over = F.when(skip | ~begins, F.col("created_at")).when(ended, F.col("then.created_at"))
    out = kept.select("document_id", "stage", "attempt", status.alias("status"), started.alias("started_at"), over.alias("ended_at"))
    return out.withColumn("microseconds", F.expr("timestampdiff(MICROSECOND, started_at, ended_at)"))


def change_feed(versions: DataFrame) -> DataFrame:
    """``document_id, version, was, status, action, bi_status`` for each change in ``versions`` (document_id, version, status, classification).

    Versions follow each other by number, whenever they arrived. A change of the state, also back to an earlier one, has
    its action if that state has one; a change of either has the report state. First versions and those that change
    nothing have no row.
    """
    order = Window.partitionBy("document_id").orderBy("version")
    before = F.lag(F.struct("status", "classification")).over(order)
    rows = versions.withColumn("before", before).where("before IS NOT NULL")
    moved = ~F.col("status").eqNullSafe(F.col("before.status"))
    changed = moved | ~F.col("classification").eqNullSafe(F.col("before.classification"))
    action = F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("status"))
    return rows.where(changed).select("document_id", "version", F.col("before.status").alias("was"), "status", F.when(moved, action).alias("action"), bi_status(F.col("status"), F.col("classification")).alias("bi_status"))
