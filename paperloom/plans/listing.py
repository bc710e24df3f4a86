"""Queries of lists, filters, pages and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing
from ..sources import views
from .access import ADMIN, ANALYST, PERSONAL
from .registry import query

_MINE = "FROM v_documents WHERE workspace_id = 'src3'"  # an administrator sees all classes
_LISTED = ("id", "name", "type", "size_kb", "classification", "status", "year", "uploaded_by")


def _list(spark: SparkSession, d: str, **params) -> DataFrame:
    return listing.filtered(views.documents(spark, d), ADMIN, params, views.users(spark, d)).select(*_LISTED)


_COLUMNS = "SELECT id, name, type, size_kb, classification, status, year, uploaded_by "


@query(f"{_COLUMNS}, last_updated_by::VARCHAR AS last_updated_by, workspace_id, file_hash, extracted_text, created_at FROM v_documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d).select(*_LISTED, F.col("last_updated_by").cast("string"), "workspace_id", "file_hash", "extracted_text", "created_at")


@query(f"{_COLUMNS} {_MINE} AND year = 2025")
def filter_year(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, year=2025)


@query(f"{_COLUMNS} {_MINE} AND (status = 'Ready' OR status = 'Failed')")
def filter_status_in(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, status="Ready, Failed,0,")


@query(f"{_COLUMNS} FROM v_documents WHERE workspace_id = 'src1' AND classification = 'Public'")
def filter_classification_allowed(spark: SparkSession, d: str) -> DataFrame:
    """What is asked for and allowed: of public and restricted an analyst gets the public ones, of restricted alone nothing."""
    docs = views.documents(spark, d)
    asked = [listing.filtered(docs, ANALYST, {"classification": c}).select(*_LISTED) for c in ("Public,Restricted", "Restricted")]
    return asked[0].union(asked[1])


@query(f"{_COLUMNS} {_MINE} AND contains(lower(name), 'c_1') AND lower(name) LIKE '%c\\_1%' ESCAPE '\\'")
def search_name_escaped(spark: SparkSession, d: str) -> DataFrame:
    """The underscore of the text asked for is no wildcard."""
    return _list(spark, d, q="C_1")


@query(f"{_COLUMNS} {_MINE} AND EXISTS (SELECT 1 FROM v_users u WHERE u.id = uploaded_by AND lower(full_name) LIKE '%00002%')")
def filter_author_semi(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, author="00002")


@query("""
SELECT d.id, d.name, u.full_name AS uploader, l.full_name AS last_updater FROM v_documents d
LEFT JOIN v_users u ON u.id = d.uploaded_by LEFT JOIN v_users l ON l.id = d.last_updated_by WHERE workspace_id = 'src3'""")
def list_with_names(spark: SparkSession, d: str) -> DataFrame:
    docs = listing.filtered(views.documents(spark, d, status=False), ADMIN, {})
    return listing.with_names(docs, views.users(spark, d)).select("id", "name", "uploader", "last_updater")


@query(f"SELECT id, name, size_kb {_MINE} ORDER BY size_kb DESC NULLS FIRST, id LIMIT 20")
def list_sorted(spark: SparkSession, d: str) -> DataFrame:
    return listing.page(listing.filtered(views.documents(spark, d, status=False), ADMIN, {}), {"sort": "size_kb"}).select("id", "name", "size_kb")


@query("SELECT id, created_at FROM (SELECT * FROM v_documents WHERE workspace_id = 'src10') ORDER BY created_at IS NULL DESC, created_at DESC, id LIMIT 20")
def list_sorted_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Newest first, those without a time before all."""
    return listing.page(listing.filtered(views.documents(spark, d, status=False), PERSONAL, {}), {}).select("id", "created_at")


@query(f"SELECT id, pages {_MINE} ORDER BY pages NULLS LAST, id LIMIT 20")
def list_sorted_pages(spark: SparkSession, d: str) -> DataFrame:
    """By number of pages, those without one last."""
    return listing.page(listing.filtered(views.documents(spark, d, status=False), ADMIN, {}), {"sort": "pages", "direction": "asc"}).select("id", "pages")


@query(f"""
SELECT id, name, type, size_kb AS "sizeKb", status, classification, year, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "uploadedAt", pages,
       '[]' AS "pageFlags", '[]' AS kpis, '[]' AS charts, '[]' AS insights {_MINE}""")
def document_list_thin(spark: SparkSession, d: str) -> DataFrame:
    """Each document in the list shape; its nested fields, shown here as JSON, are empty."""
    found = listing.thin(listing.filtered(views.documents(spark, d), ADMIN, {}))
    return found.withColumns({n: F.to_json(n) for n in listing.NESTED})


@query(f"SELECT id, name {_MINE} ORDER BY name, id LIMIT 7 OFFSET 14")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    params = {"sort": "name", "direction": "asc", "page": 3, "per_page": 7}
    return listing.page(listing.filtered(views.documents(spark, d, status=False), ADMIN, params), params).select("id", "name")


@query(f"SELECT count(*)::BIGINT AS total, greatest(1, (count(*) + 6) // 7)::BIGINT AS last_page {_MINE}")
def list_page_meta(spark: SparkSession, d: str) -> DataFrame:
    params = {"per_page": 7}
    return listing.page_meta(listing.filtered(views.documents(spark, d, status=False), ADMIN, params), params)


@query(f"SELECT status, count(*)::BIGINT AS total {_MINE} GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d).groupBy("status").agg(F.count("*").alias("total"))


@query("""
SELECT 'src3' AS workspace, count(*)::BIGINT AS total, count(*) FILTER (status = 'Ready')::BIGINT AS ready, count(*) FILTER (status = 'Processing')::BIGINT AS processing,
       count(*) FILTER (status = 'Needs Review')::BIGINT AS needs_review, count(*) FILTER (status = 'Failed')::BIGINT AS failed FROM v_documents WHERE workspace_id = 'src3'
UNION ALL SELECT 'gone', 0, 0, 0, 0, 0""")
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = views.documents(spark, d)
    rows = [listing.dashboard(docs, ADMIN._replace(workspace_id=w)).select(F.lit(w).alias("workspace"), "*") for w in ("src3", "gone")]
    return rows[0].union(rows[1])


@query("SELECT id, document_id, value, percent FROM v_entities WHERE document_id = 3 ORDER BY percent DESC, id LIMIT 20")
def entities_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The findings of one document, surest first."""
    return views.findings(spark, d, "entities", views.EVERY["entities"]).where("document_id = 3").orderBy(F.desc("percent"), "id").limit(20)
