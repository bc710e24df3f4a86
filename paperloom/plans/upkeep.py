"""Reports kept up over three rounds of changes of documents, key figures and chart points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number_or_null
from ..operators import upkeep
from ..sources import store, views
from .registry import query
from .reporting import NUMERIC

_DOC = "document_id", "workspace_id", "document_name", "classification"
_KPI_SCHEMA = "document_id long, workspace_id string, document_name string, classification string, id long, label string, value_display string, value_numeric double, trend string"
_POINT_SCHEMA = "document_id long, workspace_id string, document_name string, classification string, chart_id long, title string, sort_order int, label string, value double"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d).select(F.col("id").alias("document_id"), "workspace_id", F.col("name").alias("document_name"), "classification", "status")


def _shown(docs: DataFrame) -> DataFrame:
    """Documents, or changes of them, that the report holds; a document whose class or status changes comes or goes."""
    more = ["sign"] if "sign" in docs.columns else []
    return docs.where("classification <> 'Restricted' AND status = 'Ready'").select(*_DOC, *more)


def _moved(docs: DataFrame, which: str, **to) -> DataFrame:
    """Changes of the documents ``which``: as they were go, with other values come."""
    old = docs.where(which)
    return upkeep.signed(old, -1).unionByName(upkeep.signed(old.withColumns(to), 1))


def _kept_up(spark: SparkSession, schema: str, docs: DataFrame, children: DataFrame, news: DataFrame, gone: str) -> DataFrame:
    """All rows as batch 0, then: documents move to another workspace; children come and go; documents are restricted
    and others are ready at the same time as their children change. Batch 2 comes twice."""
    report = upkeep.Report(spark, store.shared_folder(spark, "report"), schema)
    none_d, none_c = upkeep.signed(docs.limit(0), 1), upkeep.signed(children.limit(0), 1)
    report.apply(0, upkeep.joined_changes(_shown(docs.limit(0)), _shown(upkeep.signed(docs, 1)), children.limit(0), upkeep.signed(children, 1)))
    rounds = [
        (_moved(docs, "document_id % 10 = 3", workspace_id=F.lit("moved")), none_c),
        (none_d, upkeep.signed(children.where(gone), -1).unionByName(upkeep.signed(news, 1))),
    ]
    for n, (of_docs, of_children) in enumerate(rounds, 1):
        changed = upkeep.joined_changes(_shown(docs), _shown(of_docs), children, of_children)
        for _ in range(n):
            report.apply(n, changed)
        # what the changes say, told of the tables without reading the report
        if n == 1:
            docs = docs.withColumn("workspace_id", F.when(F.col("document_id") % 10 == 3, "moved").otherwise(F.col("workspace_id")))
        else:
            children = children.where(f"NOT ({gone})").unionByName(news)
    of_docs = _moved(docs, "document_id % 5 = 1", classification=F.lit("Restricted")).unionByName(_moved(docs, "document_id % 5 = 2", status=F.lit("Ready")))
    report.apply(3, upkeep.joined_changes(_shown(docs), _shown(of_docs), children, upkeep.signed(children.where("document_id % 15 = 2"), -1)))
    return report.read()


_NOW = """
WITH d AS (SELECT id AS document_id, CASE WHEN id % 10 = 3 THEN 'moved' ELSE workspace_id END AS workspace_id, name AS document_name,
  CASE WHEN id % 5 = 1 THEN 'Restricted' ELSE classification END AS classification, CASE WHEN id % 5 = 2 THEN 'Ready' ELSE status END AS status FROM v_documents),
shown AS (SELECT document_id, workspace_id, document_name, classification FROM d WHERE classification <> 'Restricted' AND status = 'Ready')
"""


@query(f"""{_NOW}, k AS (
  SELECT id, document_id, label, value, trend FROM v_kpis WHERE document_id % 7 <> 0
  UNION ALL SELECT id + 1000000000, document_id, 'new', '12.5', NULL FROM v_kpis WHERE document_id % 9 = 0)
SELECT shown.*, k.id, k.label, k.value AS value_display, {NUMERIC} AS value_numeric, k.trend
FROM k JOIN shown USING (document_id) WHERE document_id % 15 <> 2""")
def bi_kpis_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """The report of key figures after three rounds of changes equals the one made anew."""
    kpis = views.kpis(spark, d).select("document_id", "id", "label", F.col("value").alias("value_display"), number_or_null(F.col("value")).cast("double").alias("value_numeric"), "trend")
    news = kpis.where("document_id % 9 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "label": F.lit("new"), "value_display": F.lit("12.5"), "value_numeric": F.lit(12.5), "trend": F.lit(None).cast("string")})
    return _kept_up(spark, _KPI_SCHEMA, _documents(spark, d), kpis, news, "document_id % 7 = 0")


@query(f"""{_NOW}, p AS (
  SELECT id AS chart_id, document_id, title, (i - 1)::INT AS sort_order, data[i].label AS label, data[i].value AS value
  FROM v_charts, (VALUES (1), (2), (3)) p(i) WHERE document_id % 7 <> 0 OR i <> 2
  UNION ALL SELECT id, document_id, title, 3, 'p4', NULL FROM v_charts WHERE document_id % 9 = 0)
SELECT shown.*, p.chart_id, p.title, p.sort_order, p.label, p.value FROM p JOIN shown USING (document_id) WHERE document_id % 15 <> 2""")
def bi_chart_points_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """The same for the points of charts."""
    points = views.charts(spark, d).select("document_id", F.col("id").alias("chart_id"), "title", F.posexplode("data").alias("sort_order", "p")).select("document_id", "chart_id", "title", "sort_order", "p.*")
    news = points.where("document_id % 9 = 0 AND sort_order = 0").withColumns({"sort_order": F.lit(3), "label": F.lit("p4"), "value": F.lit(None).cast("double")})
    return _kept_up(spark, _POINT_SCHEMA, _documents(spark, d), points, news, "document_id % 7 = 0 AND sort_order = 1")
