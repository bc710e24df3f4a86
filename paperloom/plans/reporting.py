"""Queries of reports, of children per document, and of nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number_or_null
from ..operators import access, load, vectors
from ..sources import views
from .registry import query

_SHOWN = "d.classification <> 'Restricted' AND d.status = 'Ready'"


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Documents that reports may hold."""
    docs = views.documents(spark, d).where("classification <> 'Restricted' AND status = 'Ready'")
    return docs.select(F.col("id").alias("document_id"), "workspace_id", F.col("name").alias("document_name"), "classification", F.col("created_at").alias("document_uploaded_at"))


def bi_kpis(spark: SparkSession, d: str) -> DataFrame:
    kpis = views.kpis(spark, d).drop("workspace_id").withColumnRenamed("value", "value_display").withColumn("value_numeric", number_or_null(F.col("value_display")).cast("double"))
    return kpis.join(shown(spark, d), "document_id").select("id", "document_id", "workspace_id", "document_name", "classification", "label", "value_display", "value_numeric", "trend", "document_uploaded_at")


NUMERIC = r"CASE WHEN regexp_full_match(k.value, '[ \t\n\r\f\v]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f\v]*') THEN trim(k.value)::DOUBLE::DECIMAL(20, 4)::DOUBLE END"
_KPIS = f"""SELECT k.id, k.document_id, d.workspace_id, d.name AS document_name, d.classification, k.label, k.value AS value_display, {NUMERIC} AS value_numeric, k.trend, d.created_at AS document_uploaded_at
FROM v_kpis k JOIN v_documents d ON d.id = k.document_id WHERE {_SHOWN}"""


@query(_KPIS)
def bi_kpis_view(spark: SparkSession, d: str) -> DataFrame:
    return bi_kpis(spark, d)


@query(f"""
SELECT c.id AS chart_id, c.document_id, d.workspace_id, c.title, (i - 1)::INT AS sort_order, c.data[i].label AS label, c.data[i].value AS value
FROM v_charts c JOIN v_documents d ON d.id = c.document_id, (VALUES (1), (2), (3)) p(i) WHERE {_SHOWN}""")
def bi_chart_points_view(spark: SparkSession, d: str) -> DataFrame:
    """Points of charts, made from the charts' own data."""
    points = views.charts(spark, d).select(F.col("id").alias("chart_id"), "document_id", "title", F.posexplode("data").alias("sort_order", "p"))
    return points.join(shown(spark, d), "document_id").select("chart_id", "document_id", "workspace_id", "title", "sort_order", "p.label", "p.value")


CREDENTIALS = [("bi_three", "src3", None), ("bi_three", "src4", "2026-01-01"), ("bi_gone", "src5", "2026-01-01")]


@query(f"SELECT * FROM ({_KPIS}) WHERE workspace_id = 'src3'")
def rls_bi_kpis(spark: SparkSession, d: str) -> DataFrame:
    """What a database role sees of the report: its one valid credential's workspace. Roles without one see nothing."""
    credentials = spark.createDataFrame(CREDENTIALS, "db_role string, workspace_id string, revoked_at string")
    view = bi_kpis(spark, d)
    return access.secured(view, credentials, "bi_three").union(access.secured(view, credentials, "bi_gone")).union(access.secured(view, credentials, "unknown"))


@query(f"SELECT id, value, {NUMERIC} AS value_numeric, coalesce(value, '') AS shown FROM v_kpis k")
def kpi_value_numeric(spark: SparkSession, d: str) -> DataFrame:
    return views.kpis(spark, d).select("id", "value", number_or_null(F.col("value")).cast("double").alias("value_numeric"), F.coalesce("value", F.lit("")).alias("shown"))


@query("""
SELECT id, status, classification, CASE WHEN classification = 'Restricted' THEN 'excluded' WHEN status = 'Ready' AND classification IS NOT NULL THEN 'synced' ELSE 'not-synced' END AS bi_status FROM v_documents""")
def bi_status(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d).select("id", "status", "classification", load.bi_status(F.col("status"), F.col("classification")).alias("bi_status"))


@query("""
SELECT d.id, d.name, c.purpose AS document_type FROM v_documents d
LEFT JOIN (SELECT document_id, max(purpose) AS purpose FROM v_runs GROUP BY document_id) c ON c.document_id = d.id""")
def doc_with_classification(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its one classification, null where there is none."""
    one = views.ai_runs(spark, d).groupBy("document_id").agg(F.max("purpose").alias("document_type"))
    return views.documents(spark, d, status=False).join(one.withColumnRenamed("document_id", "id"), "id", "left").select("id", "name", "document_type")


def findings(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {k: views.findings(spark, d, k, n) for k, n in views.EVERY.items()}


@query("""
SELECT d.id, (SELECT count(*) FROM v_entities e WHERE e.document_id = d.id)::BIGINT AS entities, (SELECT count(*) FROM v_risks r WHERE r.document_id = d.id)::BIGINT AS risks,
       (SELECT count(*) FROM v_deadlines x WHERE x.document_id = d.id)::BIGINT AS deadlines FROM v_documents d""")
def intelligence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings per document, 0 where there are none. Each kind is counted before it is joined."""
    out = views.documents(spark, d, status=False).select("id")
    for k, rows in findings(spark, d).items():
        out = out.join(rows.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(k)), "id", "left")
    return out.na.fill(0, list(views.EVERY))


@query("SELECT d.id, EXISTS (SELECT 1 FROM v_kpis k WHERE k.document_id = d.id AND k.trend = 'up') OR EXISTS (SELECT 1 FROM v_charts c WHERE c.document_id = d.id) AS has_structured_data FROM v_documents d")
def has_structured_data(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document has key figures (here those that go up) or charts."""
    have = views.kpis(spark, d).where("trend = 'up'").select("document_id").union(views.charts(spark, d).select("document_id")).distinct().select(F.col("document_id").alias("id"), F.lit(True).alias("h"))
    return views.documents(spark, d, status=False).join(have, "id", "left").select("id", F.coalesce("h", F.lit(False)).alias("has_structured_data"))


@query("""
WITH k AS (SELECT document_id, string_agg(label || '=' || value, ';' ORDER BY id) AS s FROM v_kpis GROUP BY document_id),
c AS (SELECT document_id, string_agg(title || ':' || len(data), ';' ORDER BY id) AS s FROM v_charts GROUP BY document_id),
e AS (SELECT document_id, string_agg(value || '@' || percent, ';' ORDER BY id) AS s FROM v_entities GROUP BY document_id)
SELECT d.id, coalesce(k.s, '') AS kpis, coalesce(c.s, '') AS charts, coalesce(e.s, '') AS entities
FROM v_documents d LEFT JOIN k ON k.document_id = d.id LEFT JOIN c ON c.document_id = d.id LEFT JOIN e ON e.document_id = d.id""")
def document_detail_nested(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its children in order; nested, and shown here as text."""
    col = F.col
    children = {
        "kpis": (views.kpis(spark, d), [col("label"), col("value")], lambda x: F.concat(x["label"], F.lit("="), x["value"])),
        "charts": (views.charts(spark, d), [col("title"), F.size("data").alias("n")], lambda x: F.concat(x["title"], F.lit(":"), x["n"])),
        "entities": (findings(spark, d)["entities"], [col("value"), col("percent")], lambda x: F.concat(x["value"], F.lit("@"), x["percent"])),
    }
    out = views.documents(spark, d, status=False).select("id")
    for name, (rows, fields, show) in children.items():
        listed = vectors.gathered(rows, "document_id", "id", fields, name).withColumnRenamed("document_id", "id")
        out = out.join(listed, "id", "left").withColumn(name, F.coalesce(F.array_join(F.transform(name, show), ";"), F.lit("")))
    return out


@query("""
SELECT d.id, '{"entities":[' || coalesce(e.s, '') || '],"risks":[' || coalesce(r.s, '') || '],"deadlines":[' || coalesce(x.s, '') || ']}' AS input
FROM v_documents d LEFT JOIN (SELECT document_id, string_agg('{"value":"' || value || '"}', ',' ORDER BY id) AS s FROM v_entities GROUP BY 1) e ON e.document_id = d.id
LEFT JOIN (SELECT document_id, string_agg('{"value":"' || value || '"}', ',' ORDER BY id) AS s FROM v_risks GROUP BY 1) r ON r.document_id = d.id
LEFT JOIN (SELECT document_id, string_agg('{"value":"' || value || '"}', ',' ORDER BY id) AS s FROM v_deadlines GROUP BY 1) x ON x.document_id = d.id""")
def summary_input(spark: SparkSession, d: str) -> DataFrame:
    """What a summary is made from: all findings of a document as one JSON text."""
    out = views.documents(spark, d, status=False).select("id")
    for name, rows in findings(spark, d).items():
        listed = vectors.gathered(rows, "document_id", "id", [F.col("value")], name).withColumnRenamed("document_id", "id")
        out = out.join(listed, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<value:string>>")))
    return out.select("id", F.to_json(F.struct(*views.EVERY)).alias("input"))
