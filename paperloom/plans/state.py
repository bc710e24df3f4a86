"""Queries of the pipeline's state: loading, ledgers, deduplication, changes, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import INTELLIGENCE_STAGES
from ..operators import chain, load, writes
from ..sources import store, table, views
from ..streaming import copies
from .registry import query

_LATEST = "SELECT document_id, stage, status, created_at FROM v_jobs QUALIFY row_number() OVER (PARTITION BY document_id, stage ORDER BY created_at DESC, id DESC) = 1"


@query(_LATEST)
def latest_stage_status(spark: SparkSession, d: str) -> DataFrame:
    return load.latest(views.jobs(spark, d), ["document_id", "stage"], ["status", "created_at"])


@query("SELECT document_id, " + ", ".join(f"coalesce(max(status) FILTER (stage = '{s}'), 'not_started') AS {s}" for s in INTELLIGENCE_STAGES) + f" FROM ({_LATEST}) GROUP BY document_id")
def processing_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    now = load.latest(views.jobs(spark, d), ["document_id", "stage"], ["status"])
    return now.groupBy("document_id").pivot("stage", list(INTELLIGENCE_STAGES)).agg(F.first("status")).na.fill("not_started")


@query(f"""
WITH now AS ({_LATEST}), s(stage, n) AS (VALUES {", ".join(f"('{s}', {n})" for n, s in enumerate(INTELLIGENCE_STAGES))}),
c AS (SELECT d.document_id, s.n, s.stage, coalesce(now.status, 'not_started') AS status FROM (SELECT DISTINCT document_id FROM now) d CROSS JOIN s LEFT JOIN now ON now.document_id = d.document_id AND now.stage = s.stage),
f AS (SELECT document_id, min(n) AS n FROM c WHERE status NOT IN ('completed', 'skipped') GROUP BY document_id)
SELECT DISTINCT c.document_id, coalesce(f.n, {len(INTELLIGENCE_STAGES)})::INT AS done, x.stage AS stopped_at, x.status FROM c LEFT JOIN f ON f.document_id = c.document_id LEFT JOIN c x ON x.document_id = c.document_id AND x.n = f.n""")
def chain_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each document came in the ordered chain, which stops at the first stage that has not ended well."""
    now = load.latest(views.jobs(spark, d), ["document_id", "stage"], ["status"])
    return load.chained(now, INTELLIGENCE_STAGES)


@query("SELECT document_id, stage, count(*)::BIGINT AS entries, epoch_us(max(created_at)) - epoch_us(min(created_at)) AS microseconds FROM v_jobs GROUP BY document_id, stage")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    """From the first to the last entry of each document and stage (an extension)."""
    micros = lambda f: F.unix_micros(f("created_at").cast("timestamp"))
    return views.jobs(spark, d).groupBy("document_id", "stage").agg(F.count("*").alias("entries"), (micros(F.max) - micros(F.min)).alias("microseconds"))


@query("SELECT stage AS purpose, count(*)::BIGINT AS runs, sum(json_extract(output, '$.k')::BIGINT)::BIGINT AS tokens FROM v_jobs GROUP BY stage")
def token_sums(spark: SparkSession, d: str) -> DataFrame:
    """Runs and their tokens by purpose (an extension)."""
    tokens = F.get_json_object("output", "$.k").try_cast("long")
    return views.jobs(spark, d).groupBy(F.col("stage").alias("purpose")).agg(F.count("*").alias("runs"), F.sum(tokens).alias("tokens"))


_KEPT = "SELECT id, document_id, value, percent FROM v_entities WHERE document_id % 4 <> 0"


@query(f"{_KEPT} UNION ALL SELECT id, document_id, 'new', percent FROM v_entities WHERE document_id % 4 = 0 AND document_id % 8 <> 0")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every fourth id were processed; every other of them has no findings now."""
    old = views.findings(spark, d, "entities", views.EVERY["entities"])
    processed = table(spark, d, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("document_id"))
    new = old.where("document_id % 4 = 0 AND document_id % 8 <> 0").withColumn("value", F.lit("new"))
    return load.replace_children(old, processed, new)


@query(f"{_KEPT} UNION ALL SELECT id, document_id, 'new', percent FROM v_entities WHERE document_id % 4 = 0 AND document_id % 8 <> 0")
def replace_children_written(spark: SparkSession, d: str) -> DataFrame:
    """The same as a table: all documents' children in one batch, every fourth document's anew in the next, which comes twice."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    rows = views.findings(spark, d, "entities", views.EVERY["entities"]).select("id", "document_id", "value", "percent")
    children = writes.Children(spark, store.shared_folder(spark, "children"), "id long, document_id long, value string, percent long", buckets=16)
    children.replace(0, docs, rows)
    for _ in range(2):
        children.replace(1, docs.where("document_id % 4 = 0"), rows.where("document_id % 4 = 0 AND document_id % 8 <> 0").withColumn("value", F.lit("new")))
    return children.read()


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'invoice' ELSE 'other' END AS document_type FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def upsert_classification(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    old = docs.where("document_id % 2 = 0").withColumn("document_type", F.lit("other"))
    return load.upsert(old, docs.where("document_id % 3 = 0").withColumn("document_type", F.lit("invoice")))


@query("SELECT id AS workspace_id, type <> 'Personal' AS ocr_enabled FROM v_workspaces")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Workspaces without settings get the default; settings that are there stay."""
    spaces = views.workspaces(spark, d)
    old = spaces.where("type = 'Personal'").select(F.col("id").alias("workspace_id"), F.lit(False).alias("ocr_enabled"))
    return load.insert_or_ignore(old, spaces.select(F.col("id").alias("workspace_id"), F.lit(True).alias("ocr_enabled")), "workspace_id")


@query("SELECT k.id, coalesce(CASE WHEN k.id % 3 <> 0 THEN 'own' END, d.workspace_id) AS workspace_id FROM v_kpis k JOIN v_documents d ON d.id = k.document_id")
def backfill_workspace_id(spark: SparkSession, d: str) -> DataFrame:
    children = views.kpis(spark, d).withColumn("workspace_id", F.when(F.col("id") % 3 != 0, "own"))
    return load.backfilled(children, views.documents(spark, d, status=False)).select("id", "workspace_id")


@query("""
WITH p AS (SELECT id AS chart_id, unnest(data).label AS label FROM v_charts)
SELECT p.chart_id, p.label, coalesce(CASE WHEN p.chart_id % 3 <> 0 THEN 'own' END, d.workspace_id) AS workspace_id
FROM p LEFT JOIN v_charts c ON c.id = p.chart_id LEFT JOIN v_documents d ON d.id = c.document_id""")
def backfill_points_workspace(spark: SparkSession, d: str) -> DataFrame:
    """Points of charts have no document of their own: they take the workspace of their chart's."""
    charts = views.charts(spark, d)
    points = charts.select(F.col("id").alias("chart_id"), F.explode("data.label").alias("label")).withColumn("workspace_id", F.when(F.col("chart_id") % 3 != 0, "own"))
    return load.backfilled_through(points, charts, views.documents(spark, d, status=False)).select("chart_id", "label", "workspace_id")


@query("SELECT id, document_id FROM v_kpis k WHERE EXISTS (SELECT 1 FROM v_documents d WHERE d.id = k.document_id AND d.status <> 'Failed')")
def cascade_delete_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of deleted documents go with them."""
    deleted = views.documents(spark, d).where("status = 'Failed'").select(F.col("id").alias("document_id"))
    return views.kpis(spark, d).join(deleted, "document_id", "left_anti").select("id", "document_id")


@query("SELECT id, CASE WHEN uploaded_by <> 3 THEN uploaded_by::VARCHAR END AS uploaded_by FROM v_documents")
def set_null_on_delete(spark: SparkSession, d: str) -> DataFrame:
    """References to deleted users become null."""
    gone = views.users(spark, d).where("id = 3").select(F.col("id").alias("uploaded_by"), F.lit(True).alias("gone"))
    return views.documents(spark, d, status=False).join(gone, "uploaded_by", "left").select("id", F.when(F.col("gone").isNull(), F.col("uploaded_by")).cast("string").alias("uploaded_by"))


@query("SELECT name, version, CASE WHEN name = 'prompt_3' THEN version = 1 ELSE active END AS active FROM v_prompts")
def prompt_activate(spark: SparkSession, d: str) -> DataFrame:
    return load.activated(views.prompts(spark, d), "prompt_3", 1).select("name", "version", "active")


_CHAIN = ("scan", "extract", "insights", "embeddings")


@query("""
WITH x AS (SELECT d.id, CASE WHEN substr(d.file_hash, 1, 1) = 'f' THEN 'infected' END AS scan, CASE WHEN length(d.extracted_text) < 200 THEN 'no text' END AS extract,
  o.error AS insights, CASE WHEN d.pages IS NULL THEN 'no pages' END AS embeddings FROM v_documents d JOIN ({insights}) o ON o.id = d.id)
SELECT id, CASE WHEN scan IS NOT NULL THEN 0 WHEN extract IS NOT NULL THEN 1 WHEN insights IS NOT NULL THEN 2 WHEN embeddings IS NOT NULL THEN 3 ELSE 4 END AS done,
  CASE WHEN scan IS NOT NULL THEN 'scan' WHEN extract IS NOT NULL THEN 'extract' WHEN insights IS NOT NULL THEN 'insights' WHEN embeddings IS NOT NULL THEN 'embeddings' END AS stopped_at,
  coalesce(scan, extract, insights, embeddings) AS error FROM x""".replace("{insights}", "SELECT id, CASE WHEN id % 10 IN (1, 4, 8) THEN 'bad answer' END AS error FROM v_documents"))
def chain_run(spark: SparkSession, d: str) -> DataFrame:
    """Documents through four stages in order; each stage sees what the one before it let through."""
    i = F.col("id")
    faults = {
        "scan": F.when(F.substring("file_hash", 1, 1) == "f", "infected"),
        "extract": F.when(F.length("extracted_text") < 200, "no text"),
        "insights": F.when((i % 10).isin(1, 4, 8), "bad answer"),
        "embeddings": F.when(F.col("pages").isNull(), "no pages"),
    }
    stages = [(name, lambda live, name=name: live.withColumn("error", faults[name])) for name in _CHAIN]
    return chain.run(views.documents(spark, d, status=False).select("id", "file_hash", "extracted_text", "pages"), stages, store.shared_folder(spark, "chain"))


@query("SELECT id, row_number() OVER (PARTITION BY workspace_id, file_hash ORDER BY created_at NULLS LAST, id) = 1 AS accepted FROM v_documents")
def first_copies_stored(spark: SparkSession, d: str) -> DataFrame:
    """Every document accepted or refused by the table of hashes that streams keep."""
    docs = views.documents(spark, d, status=False).select("id", "workspace_id", "file_hash", "created_at")
    return copies.FirstCopies(spark, store.shared_folder(spark, "copies")).judge(docs, 0).select("id", "accepted")


@query("""
SELECT id, workspace_id, file_hash, count(*) OVER (PARTITION BY workspace_id, file_hash)::BIGINT AS copies FROM v_documents
QUALIFY row_number() OVER (PARTITION BY workspace_id, file_hash ORDER BY created_at NULLS LAST, id) = 1""")
def dedup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return load.first_copies(views.documents(spark, d, status=False))


@query("""
SELECT d.id, coalesce(r.file_hash = d.file_hash, false) AS skip FROM v_documents d LEFT JOIN (
  SELECT document_id, file_hash FROM v_runs WHERE purpose = 'risks' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1) r ON r.document_id = d.id""")
def skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return load.to_skip(views.documents(spark, d, status=False), views.ai_runs(spark, d), "risks")


_EVENTS = ("approve", "reject", "reprocess", "failed", "insights", "ocr_failed")


@query(f"""
SELECT id, status, event, CASE status || '/' || event WHEN 'Processing/failed' THEN 'Failed' WHEN 'Processing/ocr_failed' THEN 'Needs Review' WHEN 'Processing/insights' THEN 'Ready'
  WHEN 'Needs Review/approve' THEN 'Ready' WHEN 'Needs Review/reject' THEN 'Failed' WHEN 'Needs Review/reprocess' THEN 'Processing' END AS next
FROM (SELECT id, status, {list(_EVENTS)}[id % {len(_EVENTS)} + 1] AS event FROM v_documents)""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    docs = views.documents(spark, d).withColumn("event", views.pick(F.col("id"), *_EVENTS))
    return docs.select("id", "status", "event", load.next_status(F.col("status"), F.col("event")).alias("next"))


@query("""
WITH n AS (SELECT id, status AS was, classification AS c, CASE WHEN id % 4 = 0 THEN 'Ready' WHEN id % 4 = 1 THEN 'Failed' ELSE status END AS status, CASE WHEN id % 6 = 2 THEN 'Restricted' ELSE classification END AS classification FROM v_documents)
SELECT id, was, status, CASE WHEN was <> status THEN CASE status WHEN 'Ready' THEN 'document.approved' WHEN 'Failed' THEN 'document.failed' END END AS action,
  CASE WHEN classification = 'Restricted' THEN 'excluded' WHEN status = 'Ready' THEN 'synced' ELSE 'not-synced' END AS bi_status FROM n WHERE was <> status OR c IS DISTINCT FROM classification""")
def cdc_status_audit(spark: SparkSession, d: str) -> DataFrame:
    """What two snapshots of the documents say of the changes between them."""
    old, i = views.documents(spark, d).select("id", "status", "classification"), F.col("id")
    status = F.when(i % 4 == 0, "Ready").when(i % 4 == 1, "Failed").otherwise(F.col("status"))
    return load.changes(old, old.select("id", status.alias("status"), F.when(i % 6 == 2, "Restricted").otherwise(F.col("classification")).alias("classification")))


@query("""SELECT event_id AS id, user_id, 'src' || (user_id % 20) AS workspace_id, 'document.search' AS action, '{"query":"q' || event_id || '","result_count":' || event_id % 10 || '}' AS metadata FROM events WHERE event_type = 'view'""")
def audit_events(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows of searches; who has no workspace named gets that of the subject."""
    e, named = F.col("event_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("src"), F.col("user_id") % 20))
    metadata = F.to_json(F.struct(F.concat(F.lit("q"), e).alias("query"), (e % 10).alias("result_count")))
    return table(spark, d, "events").where("event_type = 'view'").select(e.alias("id"), "user_id", F.coalesce(named, F.concat(F.lit("src"), F.col("user_id") % 20)).alias("workspace_id"), F.lit("document.search").alias("action"), metadata.alias("metadata"))


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, least(count(*), 2)::BIGINT AS allowed, greatest(count(*) - 2, 0)::BIGINT AS refused FROM events GROUP BY 1, 2")
def rate_limit_daily(spark: SparkSession, d: str) -> DataFrame:
    return load.rate_limited(table(spark, d, "events"), 2, "1 day")


@query("SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, least(count(*), 20)::BIGINT AS allowed, greatest(count(*) - 20, 0)::BIGINT AS refused FROM events GROUP BY 1, 2")
def rate_limit_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Twenty an hour; hours are the clock's, not counted from a user's first event."""
    return load.rate_limited(table(spark, d, "events"), 20)
