"""Queries over ordered histories: limits counted from the first hit, states after all events, runs, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, limits
from ..operators.load import ACTIONS, TRANSITIONS
from ..sources import table, views
from .registry import query
from .state import _EVENTS


def _limits_sql(key: str, seconds: int, most: int, patience: int) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT event_id AS id, {key} AS key, epoch_us(ts) AS t FROM events),
s(key, t) AS (SELECT key, min(t) FROM e GROUP BY key UNION ALL SELECT s.key, min(e.t) FROM s JOIN e ON e.key = s.key AND e.t >= s.t + {seconds}000000 GROUP BY s.key),
h AS (SELECT e.id, e.t, s.t AS opened, row_number() OVER (PARTITION BY e.key, s.t ORDER BY e.t, e.id) AS hit FROM e JOIN s ON s.key = e.key AND e.t >= s.t AND e.t < s.t + {seconds}000000)
SELECT id, make_timestamp(opened) AS bucket_start, hit, CASE WHEN hit <= {most} THEN 'allowed' WHEN opened + {seconds}000000 - t <= {patience}000000 THEN 'delayed' ELSE 'refused' END AS verdict FROM h"""


@query(_limits_sql("user_id", 86_400, 2, 21_600))
def rate_limit_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A verdict for each event: two a user in the day that begins with the user's first event, a quarter of a day's patience."""
    hits = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    return limits.verdicts(hits, 86_400, 2, 21_600)


@query(_limits_sql("1", 3_600, 10, 600))
def rate_limit_global(spark: SparkSession, d: str) -> DataFrame:
    """One limit for all callers: every event has the same key."""
    hits = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(1).alias("key"), "ts")
    return limits.verdicts(hits, 3_600, 10, 600)


_NEXT = "CASE w.status || '/' || h.event " + " ".join(f"WHEN '{was}/{what}' THEN '{then}'" for (was, what), then in TRANSITIONS.items()) + " END"


@query(f"""
WITH RECURSIVE h AS (SELECT user_id AS document_id, event_id AS id, {list(_EVENTS)}[event_id % {len(_EVENTS)} + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(document_id, n, status, refused, first_refused) AS (
  SELECT DISTINCT document_id, 0::BIGINT, 'Processing', 0::BIGINT, NULL::BIGINT FROM h UNION ALL
  SELECT w.document_id, h.n, coalesce({_NEXT}, w.status), w.refused + CASE WHEN {_NEXT} IS NULL THEN 1 ELSE 0 END, coalesce(w.first_refused, CASE WHEN {_NEXT} IS NULL THEN h.id END)
  FROM w JOIN h ON h.document_id = w.document_id AND h.n = w.n + 1)
SELECT document_id, n AS events, status, refused, first_refused FROM w QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1""")
def status_histories(spark: SparkSession, d: str) -> DataFrame:
    """Every document's state after all its events, and the first that was refused."""
    e = F.col("event_id")
    return history.final_states(table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"), e.alias("id"), views.pick(e, *_EVENTS).alias("event")))


@query("""
WITH j AS (SELECT *, count(*) FILTER (status = 'processing') OVER (PARTITION BY document_id, stage ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS attempt FROM v_jobs),
o AS (SELECT *, lead(status) OVER w AS ns, lead(created_at) OVER w AS nt, lag(status) OVER w AS ps FROM j WHERE status <> 'skipped' WINDOW w AS (PARTITION BY document_id, stage ORDER BY created_at, id)),
r AS (
  SELECT document_id, stage, attempt, 'skipped' AS status, created_at AS started_at, created_at AS ended_at FROM j WHERE status = 'skipped' UNION ALL
  SELECT document_id, stage, attempt, CASE WHEN ns IS NULL THEN 'open' WHEN ns = 'processing' THEN 'orphaned' ELSE ns END, created_at, CASE WHEN ns <> 'processing' THEN nt END FROM o WHERE status = 'processing' UNION ALL
  SELECT document_id, stage, attempt, 'unstarted', NULL, created_at FROM o WHERE status <> 'processing' AND ps IS DISTINCT FROM 'processing')
SELECT document_id, stage, attempt::BIGINT AS attempt, status, started_at, ended_at, epoch_us(ended_at) - epoch_us(started_at) AS microseconds FROM r""")
def stage_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the ledger: every start with its own end, and what has none."""
    return history.stage_runs(views.jobs(spark, d))


_STATUS, _KIND = ("Processing", "Needs Review", "Ready", "Ready", "Failed"), ("Public", "Restricted", "Internal", "Internal")


@query(f"""
WITH v AS (SELECT user_id AS document_id, event_id AS version, {list(_STATUS)}[event_id % 5 + 1] AS status, {list(_KIND)}[event_id % 4 + 1] AS classification FROM events),
b AS (SELECT *, lag(status) OVER w AS was, lag(classification) OVER w AS kind, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY document_id ORDER BY version))
SELECT document_id, version, was, status, CASE WHEN was <> status THEN CASE status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} END END AS action,
  CASE WHEN classification = 'Restricted' THEN 'excluded' WHEN status = 'Ready' THEN 'synced' ELSE 'not-synced' END AS bi_status
FROM b WHERE n > 1 AND (was <> status OR kind <> classification)""")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Every change between successive versions of a document."""
    e = F.col("event_id")
    versions = table(spark, d, "events").select(F.col("user_id").alias("document_id"), e.alias("version"), views.pick(e, *_STATUS).alias("status"), views.pick(e, *_KIND).alias("classification"))
    return history.change_feed(versions)
