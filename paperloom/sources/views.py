"""The document model's tables, derived from the data folder. ``SQL`` holds the same definitions for the oracles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import table


def pick(number: Column, *values: str | None) -> Column:
    """The value at place ``number`` modulo their count."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def documents(spark: SparkSession, d: str, status: bool = True) -> DataFrame:
    """All documents; ``status`` needs a join with the labels, so it can be left out."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    if status:
        docs = docs.join(table(spark, d, "labels"), "doc_id", "left")
    state = F.when(F.col("toxic") == 1, "Failed").when(F.col("quality") == 0, "Needs Review").when(F.col("quality") == 1, "Ready").otherwise("Processing") if status else F.lit(None).cast("string")
    kind = F.when(F.col("lang") == "en", "Public").when(F.col("lang") == "fr", "Internal").when(F.col("lang") == "de", "Confidential").when(F.col("lang") == "es", "Restricted")
    return docs.select(
        i.alias("id"),
        F.concat(F.lit("Doc_"), i, F.lit("%"), F.col("lang"), F.lit(".pdf")).alias("name"),
        pick(i, "PDF", "DOCX", "XLSX").alias("type"),
        F.ceil(F.col("n_chars") / 1024).cast("long").alias("size_kb"),
        kind.alias("classification"),
        state.alias("status"),
        (2024 + i % 3).cast("long").alias("year"),
        (i % 7).alias("uploaded_by"),
        F.when(i % 5 != 0, i % 7).alias("last_updated_by"),
        F.when(i % 50 != 0, F.col("source")).alias("workspace_id"),
        F.when(i % 11 != 0, i % 13 + 1).alias("pages"),
        F.sha2("text", 256).alias("file_hash"),
        F.col("text").alias("extracted_text"),
        F.when(i % 97 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")).alias("created_at"),
    )


def workspaces(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.col("source").alias("id")).distinct()
    return ids.select("id", F.when(F.substring("id", 4, 9).cast("int") % 10 == 0, "Personal").otherwise("Organization").alias("type"))


def users(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    return table(spark, d, "customer").select(
        i.alias("id"), F.col("c_name").alias("full_name"), F.concat(F.lit(" User"), i, F.lit("@Example.COM \n")).alias("email"), F.lit("secret").alias("password"),
        pick(i, "Viewer", "Analyst", "Reviewer", "Administrator", "Owner").alias("role"), (i % 4 != 0).alias("active"), F.when(i != 6, F.concat(F.lit("src"), i)).alias("current_workspace_id"),
    )


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("document_id"), (F.col("vec_id") % 4).alias("chunk_index"), "embedding")
    docs = documents(spark, d, status=False).select(F.col("id").alias("document_id"), "workspace_id", "extracted_text")
    text = F.substring(F.col("extracted_text"), (1 + 200 * F.col("chunk_index")).cast("int"), F.lit(200))
    return chunks.join(docs, "document_id").select(F.col("vec_id").alias("id"), "document_id", "chunk_index", "workspace_id", "embedding", text.alias("chunk_text"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of processing stages."""
    e = F.col("event_id")
    stage = F.create_map(*[F.lit(x) for kv in (("view", "document_type"), ("click", "entities"), ("error", "risks"), ("signup", "deadlines"), ("purchase", "document_summary")) for x in kv])
    return table(spark, d, "events").select(e.alias("id"), F.col("user_id").alias("document_id"), F.element_at(stage, F.col("event_type")).alias("stage"), F.col("ts").alias("created_at"), pick(e, "completed", "failed", "skipped", "processing").alias("status"), F.col("props").alias("output"))


def ai_runs(spark: SparkSession, d: str) -> DataFrame:
    """Model runs: every other one saw the document as it is."""
    hashes = documents(spark, d, status=False).select(F.col("id").alias("document_id"), "file_hash")
    runs = jobs(spark, d).select("id", "document_id", F.col("stage").alias("purpose"), "created_at")
    return runs.join(hashes, "document_id").select("id", "document_id", "purpose", "created_at", F.when(F.col("id") % 2 == 0, F.col("file_hash")).otherwise("stale").alias("file_hash"))


def kpis(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    value = F.coalesce(pick(i, "64.2M", "12,430", None, "1e3", " 12.5 ", "1d"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select(i.alias("id"), i.alias("document_id"), F.col("lang").alias("label"), value.alias("value"), pick(i, "up", "down", "flat").alias("trend"), F.when(i % 50 != 0, F.col("source")).alias("workspace_id"))


def charts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    points = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.struct(F.concat(F.lit("p"), k).alias("label"), (i * k).cast("double").alias("value")))
    return table(spark, d, "documents").where(i % 4 == 0).select(i.alias("id"), i.alias("document_id"), F.concat(F.lit("Chart "), i).alias("title"), points.alias("data"))


def findings(spark: SparkSession, d: str, kind: str, every: int) -> DataFrame:
    """Entities, risks or deadlines: ``id % every`` of them for a document."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").where(i % every > 0).select(i.alias("document_id"), F.explode(F.sequence(F.lit(1).cast("long"), i % every)).alias("k"))
    return rows.select((F.col("document_id") * 10 + F.col("k")).alias("id"), "document_id", F.concat(F.lit(kind + " "), F.col("k")).alias("value"), ((F.col("document_id") * 7 + F.col("k") * 13) % 100).cast("long").alias("percent"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Each user is in two workspaces, in the second as an analyst."""
    u = users(spark, d).select(F.col("id").alias("user_id"), F.posexplode(F.array(F.col("id"), F.col("id") + 1)).alias("k", "n"), "role")
    return u.select("user_id", F.concat(F.lit("src"), "n").alias("workspace_id"), F.when(F.col("k") == 0, F.col("role")).otherwise("Analyst").alias("role"))


def audit_logs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), F.when(e % 2 == 0, "document").otherwise("user").alias("auditable_type"), F.col("user_id").alias("auditable_id"), F.concat(F.lit("event."), "event_type").alias("action"))


def of_documents(spark: SparkSession, d: str, values: tuple[str, ...], name: str) -> DataFrame:
    """A text for each document, its id filled in: made-up model output and recogniser tables."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("id"), F.replace(pick(i, *values), F.lit("<id>"), i.cast("string")).alias(name))


def ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    """Two pages a document, page 2 first."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(2).cast("long"), F.lit(1).cast("long"))).alias("page_number"))
    i = F.col("id") + F.col("page_number")
    return rows.select("id", "page_number", F.replace(pick(i, *TSV), F.lit("<id>"), i.cast("string")).alias("tsv"))


_HEAD = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"


def _tsv(*words: tuple[str, str]) -> str:
    return "\n".join([_HEAD, *("5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t" + conf + "\t" + word for conf, word in words)])


#: Recogniser tables: whole, with dropped words, with a short row, and without words.
TSV = (
    _tsv(("90.5", "Page"), ("80.25", "<id>"), ("96", "total")),
    _tsv(("-1", ""), ("91", "Annual"), ("40", "  "), ("88.5", "report"), ("-1", "lost")),
    _tsv(("75", "short")) + "\n5\t1\t1\t99\tcut",
    _HEAD,
)
_ENTITY = '{"entity_type":"person","value":"V<id>","normalized_value":"v-<id>","confidence":0.75}'
_RISK = '{"title":"T<id>","description":"d","severity":"high","confidence":0.5,"evidence":"e"}'
_DEADLINE = '{"title":"T<id>","description":"d","date_type":"explicit","due_date":"2026-07-14","confidence":1,"evidence":"e"}'


def _lists(field: str, good: str, *second: str) -> tuple[str, ...]:
    return (*(f'{{"{field}":[{good},{x}]}}' for x in second), f'```json\n{{"{field}":[{good}]}}\n```', "Sorry, no.", f'{{"{field}":[]}}', '{"other":1}', f'{{"{field}":{{"z":{good},"a":{second[0]}}}}}', f'{{"{field}":{{"z":{second[1]},"a":7}}}}', f'{{"{field}":{{}}}}', f'{{"{field}":"none"}}')


#: Made-up model output by kind, with planted violations.
RESPONSES = {
    "entities": _lists("entities", _ENTITY, '{"entity_type":"date","value":"x","confidence":1}', '{"entity_type":"alien","value":"x","confidence":0.5}', '{"entity_type":"date","value":" \\t","confidence":0.5}', '{"entity_type":"date","value":"x","confidence":1.5}', '{"entity_type":"date","value":"x","confidence":"0.9"}', '{"entity_type":"date","confidence":0.5}', "7", '{"entity_type":null,"value":"x","confidence":0.5}'),
    "risks": _lists("risks", _RISK, '{"title":"x","description":"d","severity":"low","confidence":"1e-1","evidence":"e"}', '{"title":"x","description":"d","severity":"huge","confidence":0.5,"evidence":"e"}', '{"title":5,"description":"d","severity":"low","confidence":0.5,"evidence":"e"}', '{"title":"x","description":"d","severity":"low","confidence":-0.5,"evidence":"e"}', '{"title":"x","description":"d","severity":"low","confidence":0.5,"evidence":""}', '{"title":"x","severity":"low","confidence":0.5,"evidence":"e"}'),
    "deadlines": _lists("deadlines", _DEADLINE, '{"title":"x","description":"d","date_type":"relative","due_date":null,"relative_text":"in May","confidence":0.5,"evidence":"e"}', '{"title":"x","description":"d","date_type":"relative","due_date":"2026-07-14","confidence":0.5,"evidence":"e"}', '{"title":"x","description":"d","date_type":"explicit","confidence":0.5,"evidence":"e"}', '{"title":"x","description":"d","date_type":"explicit","due_date":"14 July 2026","confidence":0.5,"evidence":"e"}', '{"title":"x","description":"d","date_type":"someday","confidence":0.5,"evidence":"e"}', '{"title":"x","description":"d","date_type":"inferred","confidence":"high","evidence":"e"}', '{"title":"x","description":"d","date_type":"explicit","due_date":"2026-2-3","confidence":0.5,"evidence":"e"}'),
    "document_type": ('{"document_type":"invoice","confidence":0.8,"reasoning":"r"}', '{"document_type":"poem","confidence":0.8,"reasoning":"r"}', '{"document_type":3,"confidence":0.8,"reasoning":"r"}', '{"document_type":"other","confidence":"0.25","reasoning":"r"}', '{"document_type":"other","confidence":2,"reasoning":"r"}', '{"document_type":"other","reasoning":"r"}', '{"document_type":"contract","confidence":1,"reasoning":"  "}', '"invoice"', "[]"),
    "summary": ('{"executive_summary":"s","key_findings":["a"],"critical_risks":[],"upcoming_deadlines":[],"important_entities":["b","c"],"recommended_attention":[]}', '{"executive_summary":" ","key_findings":["a"],"critical_risks":[],"upcoming_deadlines":[],"important_entities":[],"recommended_attention":[]}', '{"executive_summary":"s","key_findings":["a",5],"critical_risks":[],"upcoming_deadlines":[],"important_entities":[],"recommended_attention":[]}', '{"executive_summary":"s","key_findings":["a"],"critical_risks":[]}', '{"executive_summary":"s","key_findings":["a"],"critical_risks":null,"upcoming_deadlines":[],"important_entities":[],"recommended_attention":[]}', '{"executive_summary":"s","key_findings":{"one":"a","two":"b"},"critical_risks":{},"upcoming_deadlines":[],"important_entities":[],"recommended_attention":[]}', '{"executive_summary":"s","key_findings":{"z":"a","b":5,"a":6},"critical_risks":[],"upcoming_deadlines":7,"important_entities":[],"recommended_attention":[]}'),
    "qa": ('{"answer":"a","confidence":"strong","cited_document_ids":["<id>"]}', '{"answer":"a","confidence":"strong","cited_document_ids":["<id>","9x"]}', '{"answer":"a","confidence":"sure","cited_document_ids":[]}', '{"answer":"a","confidence":"none","cited_document_ids":["<id>"]}', '{"answer":"a","confidence":"none","cited_document_ids":[]}', '{"answer":"a","confidence":"weak","cited_document_ids":[5]}', '{"answer":"","confidence":"weak","cited_document_ids":[]}', '{"answer":"a","confidence":"weak"}', '{"answer":"a","confidence":"strong","cited_document_ids":{"first":"<id>"}}', '{"answer":"a","confidence":"strong","cited_document_ids":{"z":"<id>","b":"9y","a":"9x"}}', '{"answer":"a","confidence":"none","cited_document_ids":{}}'),
    "insights": ('{"kpis":[],"charts":[],"summary":"s","score":"3.5"}', '{"kpis":"x"}', '{"summary":7}', '{"score":"high"}', '{"charts":null}', "{}", '{"kpis":{"a":1}}', '{"kpis":1.5,"charts":[]}', '{"kpis":[],"charts":true}', '{"charts":12}'),
}


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Four versions of a prompt for every four documents, one of them active; templates are the documents' first lines."""
    i = F.col("doc_id")
    number = F.expr("doc_id div 4")
    return table(spark, d, "documents").select(F.concat(F.lit("prompt_"), number).alias("name"), (i % 4 + 1).alias("version"), (i % 4 == number % 4).alias("active"), F.substring_index("text", "\n", 1).alias("template"))


def responses(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return of_documents(spark, d, RESPONSES[kind], "raw_json")


def _text_sql(values: tuple[str, ...], number: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"replace([{quoted}][({number}) % {len(values)} + 1], '<id>', ({number})::VARCHAR)"


SQL = {
    "v_documents": """
SELECT doc_id AS id, 'Doc_' || doc_id || '%' || lang || '.pdf' AS name, ['PDF', 'DOCX', 'XLSX'][doc_id % 3 + 1] AS type,
       ((n_chars + 1023) // 1024)::BIGINT AS size_kb,
       CASE lang WHEN 'en' THEN 'Public' WHEN 'fr' THEN 'Internal' WHEN 'de' THEN 'Confidential' WHEN 'es' THEN 'Restricted' END AS classification,
       CASE WHEN toxic = 1 THEN 'Failed' WHEN quality = 0 THEN 'Needs Review' WHEN quality = 1 THEN 'Ready' ELSE 'Processing' END AS status,
       (2024 + doc_id % 3)::BIGINT AS year, doc_id % 7 AS uploaded_by, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 7 END AS last_updated_by,
       CASE WHEN doc_id % 50 = 0 THEN NULL ELSE source END AS workspace_id, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 13 + 1 END AS pages, sha256(text) AS file_hash, text AS extracted_text,
       CASE WHEN doc_id % 97 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS created_at
FROM documents LEFT JOIN labels USING (doc_id)""",
    "v_workspaces": "SELECT DISTINCT source AS id, CASE WHEN substr(source, 4)::INT % 10 = 0 THEN 'Personal' ELSE 'Organization' END AS type FROM documents",
    "v_users": """
SELECT c_custkey AS id, c_name AS full_name, ' User' || c_custkey || '@Example.COM ' || chr(10) AS email,
       ['Viewer', 'Analyst', 'Reviewer', 'Administrator', 'Owner'][c_custkey % 5 + 1] AS role, c_custkey % 4 <> 0 AS active,
       CASE WHEN c_custkey = 6 THEN NULL ELSE 'src' || c_custkey END AS current_workspace_id
FROM customer""",
    "v_embeddings": """
SELECT e.vec_id AS id, e.vec_id // 4 AS document_id, e.vec_id % 4 AS chunk_index, d.workspace_id, e.embedding::DOUBLE[] AS embedding,
       substr(d.extracted_text, 1 + 200 * (e.vec_id % 4), 200) AS chunk_text
FROM embeddings e JOIN v_documents d ON d.id = e.vec_id // 4""",
    "v_jobs": """
SELECT event_id AS id, user_id AS document_id,
       CASE event_type WHEN 'view' THEN 'document_type' WHEN 'click' THEN 'entities' WHEN 'error' THEN 'risks' WHEN 'signup' THEN 'deadlines' WHEN 'purchase' THEN 'document_summary' END AS stage,
       ts AS created_at, ['completed', 'failed', 'skipped', 'processing'][event_id % 4 + 1] AS status, props AS output FROM events""",
    "v_runs": """
SELECT j.id, j.document_id, j.stage AS purpose, j.created_at, CASE WHEN j.id % 2 = 0 THEN d.file_hash ELSE 'stale' END AS file_hash
FROM v_jobs j JOIN v_documents d ON d.id = j.document_id""",
    "v_kpis": """
SELECT doc_id AS id, doc_id AS document_id, lang AS label, coalesce(['64.2M', '12,430', NULL, '1e3', ' 12.5 ', '1d'][doc_id % 6 + 1], n_chars::VARCHAR) AS value,
       ['up', 'down', 'flat'][doc_id % 3 + 1] AS trend, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE source END AS workspace_id FROM documents""",
    "v_charts": """
SELECT doc_id AS id, doc_id AS document_id, 'Chart ' || doc_id AS title, [{'label': 'p' || k, 'value': (doc_id * k)::DOUBLE} FOR k IN [1, 2, 3]] AS data
FROM documents WHERE doc_id % 4 = 0""",
} | {
    f"v_{kind}": f"""
SELECT doc_id * 10 + k AS id, doc_id AS document_id, '{kind} ' || k AS value, ((doc_id * 7 + k * 13) % 100)::BIGINT AS percent
FROM documents, range(1, {every}) r(k) WHERE k <= doc_id % {every}"""
    for kind, every in (("entities", 4), ("risks", 3), ("deadlines", 2))
}
SQL |= {
    "v_members": "SELECT id AS user_id, 'src' || (id + k) AS workspace_id, CASE WHEN k = 0 THEN role ELSE 'Analyst' END AS role FROM v_users, (VALUES (0), (1)) t(k)",
    "v_prompts": "SELECT 'prompt_' || (doc_id // 4) AS name, doc_id % 4 + 1 AS version, doc_id % 4 = (doc_id // 4) % 4 AS active, split_part(text, chr(10), 1) AS template FROM documents",
    "v_audit": "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'document' ELSE 'user' END AS auditable_type, user_id AS auditable_id, 'event.' || event_type AS action FROM events",
    "v_ocr": f"SELECT doc_id AS id, page_number::BIGINT AS page_number, {_text_sql(TSV, 'doc_id + page_number')} AS tsv FROM documents, (VALUES (2), (1)) p(page_number)",
} | {f"v_{kind}_out": f"SELECT doc_id AS id, {_text_sql(values, 'doc_id')} AS raw_json FROM documents" for kind, values in RESPONSES.items()}
#: Findings a document can have, plus one.
EVERY = {"entities": 4, "risks": 3, "deadlines": 2}


def with_views(sql: str) -> str:
    """An oracle over the views that it names, and those that they name."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(SQL[name])
                needed.append(name)

    need(sql)
    views = ",\n".join(f"{name} AS ({SQL[name]})" for name in needed)
    if not views:
        return sql
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    return f"WITH {own and own[1] or ''}{views}" + (", " + sql[own.end() :] if own else "\n" + sql)
