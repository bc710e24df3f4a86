"""Queries of access control. Callers: an organisation's administrator, and a personal workspace's owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import ROLES_BY_CLASSIFICATION
from ..operators import access
from ..operators.access import Caller
from ..sources import views
from .registry import query

ADMIN, ANALYST, OWNER, NOBODY = Caller(3, "Administrator", "src3"), Caller(1, "Analyst", "src1"), Caller(4, "Owner", "src4"), Caller(6, "Analyst")
PERSONAL = Caller(3, "Viewer", "src10", personal=True)
_ALLOWED = " OR ".join(f"(classification = '{c}' AND role IN ({', '.join(repr(r) for r in roles)}))" for c, roles in ROLES_BY_CLASSIFICATION.items())


def caller(users: DataFrame, docs: DataFrame, spaces: DataFrame) -> DataFrame:
    """Each user with each document (or group of them) that is in question for them: of their workspace, or of their own."""
    u = users.select(F.col("id").alias("user_id"), "role", "current_workspace_id")
    own = spaces.select(F.col("id").alias("workspace_id"), (F.col("type") == "Personal").alias("personal"))
    d = docs.join(own, "workspace_id", "left")
    same = F.col("workspace_id").eqNullSafe(F.col("current_workspace_id"))
    uploaded = access.join_spread(d.where(F.col("uploaded_by").isNotNull()), u, "uploaded_by", "user_id").where(~same)
    near = access.join_spread(d, u, "workspace_id", "current_workspace_id").union(uploaded)
    view = access.may_view(F.col("personal"), F.col("uploaded_by"), F.col("workspace_id"), F.col("classification"), F.col("user_id"), F.col("role"), F.col("current_workspace_id"))
    return near.withColumn("may_view", view).withColumn("may_review", access.may_review(F.col("may_view"), F.col("personal"), F.col("role")))


_NEAR = f"""
WITH near AS (
  SELECT d.id, u.id AS user_id, u.role, coalesce(w.type = 'Personal', false) AS personal, d.uploaded_by, d.workspace_id, u.current_workspace_id, d.classification
  FROM v_documents d JOIN v_users u ON d.workspace_id IS NOT DISTINCT FROM u.current_workspace_id OR d.uploaded_by = u.id LEFT JOIN v_workspaces w ON w.id = d.workspace_id),
seen AS (SELECT *, CASE WHEN personal THEN uploaded_by = user_id ELSE workspace_id IS NOT DISTINCT FROM current_workspace_id AND ({_ALLOWED}) END AS may_view FROM near)
"""


@query("SELECT id, classification FROM v_documents WHERE workspace_id IS NULL")
def tenant_filter_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    return access.of_tenant(views.documents(spark, d, status=False), None).select("id", "classification")


@query("SELECT id, classification FROM v_documents WHERE workspace_id = NULL OR workspace_id = 'src3'")
def tenant_filter_strict(spark: SparkSession, d: str) -> DataFrame:
    docs = views.documents(spark, d, status=False)
    return access.of_tenant(docs, None, null_safe=False).union(access.of_tenant(docs, "src3", null_safe=False)).select("id", "classification")


@query("SELECT id, classification FROM v_documents WHERE workspace_id = 'src1' AND classification IN ('Public', 'Internal', 'Confidential')")
def acl_org_visible(spark: SparkSession, d: str) -> DataFrame:
    """An analyst sees three classes; an owner, a role that is not known, sees nothing."""
    docs = views.documents(spark, d, status=False)
    return access.visible(docs, ANALYST).union(access.visible(docs, OWNER)).select("id", "classification")


@query("SELECT id, 'search' AS mode FROM v_documents WHERE workspace_id = 'src10' AND uploaded_by = 3 UNION ALL SELECT id, 'list' FROM v_documents WHERE workspace_id = 'src10'")
def acl_personal_owner(spark: SparkSession, d: str) -> DataFrame:
    docs = views.documents(spark, d, status=False)
    modes = [access.visible(docs, PERSONAL, search=m == "search").select("id", F.lit(m).alias("mode")) for m in ("search", "list")]
    return modes[0].union(modes[1])


@query(_NEAR + "SELECT user_id, role, count(*) FILTER (may_view)::BIGINT AS documents FROM seen GROUP BY user_id, role")
def acl_all_users_matrix(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each user sees: documents that policies can't tell apart are counted before they meet users."""
    groups = views.documents(spark, d, status=False).groupBy("workspace_id", "classification", "uploaded_by").agg(F.count("*").alias("n"))
    near = caller(views.users(spark, d), groups, views.workspaces(spark, d))
    return near.groupBy("user_id", "role").agg(F.sum(F.when(F.col("may_view"), F.col("n")).otherwise(0)).alias("documents"))


def _policy_fields(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d, status=False).select("id", "workspace_id", "classification", "uploaded_by")


@query(_NEAR + "SELECT id, user_id, may_view FROM seen")
def policy_view_matrix(spark: SparkSession, d: str) -> DataFrame:
    return caller(views.users(spark, d), _policy_fields(spark, d), views.workspaces(spark, d)).select("id", "user_id", "may_view")


@query(_NEAR + "SELECT id, user_id, may_view AND (personal OR role IN ('Administrator', 'Reviewer')) AS may_review FROM seen")
def policy_approve_matrix(spark: SparkSession, d: str) -> DataFrame:
    return caller(views.users(spark, d), _policy_fields(spark, d), views.workspaces(spark, d)).select("id", "user_id", "may_review")


@query("SELECT count(*) AS n FROM v_users WHERE active AND role = 'Administrator' AND id <> 0")
def remaining_admins(spark: SparkSession, d: str) -> DataFrame:
    return access.remaining_admins(views.users(spark, d), but=0)


@query("SELECT id, full_name, lower(trim(email, ' ' || chr(9) || chr(10) || chr(13) || chr(11))) AS email, role, active FROM v_users")
def users_safe_fields(spark: SparkSession, d: str) -> DataFrame:
    """Users without what must not leave the table."""
    from ..functions.columns import trimmed

    return views.users(spark, d).select("id", "full_name", F.lower(trimmed(F.col("email"))).alias("email"), "role", "active")


@query("SELECT m.workspace_id, w.type, m.user_id, u.full_name, m.role FROM v_members m JOIN v_workspaces w ON w.id = m.workspace_id JOIN v_users u ON u.id = m.user_id")
def workspace_members_join(spark: SparkSession, d: str) -> DataFrame:
    m, w, u = views.members(spark, d), views.workspaces(spark, d).withColumnRenamed("id", "workspace_id"), views.users(spark, d).select(F.col("id").alias("user_id"), "full_name")
    return m.join(w, "workspace_id").join(u, "user_id").select("workspace_id", "type", "user_id", "full_name", "role")


@query("""
SELECT a.id, a.action, a.auditable_type, coalesce(d.name, u.full_name) AS subject FROM v_audit a
LEFT JOIN v_documents d ON a.auditable_type = 'document' AND d.id = a.auditable_id LEFT JOIN v_users u ON a.auditable_type = 'user' AND u.id = a.auditable_id
WHERE coalesce(d.name, u.full_name) IS NOT NULL""")
def audit_polymorphic(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows with the name of what they are about, by its type; each type is joined on its own."""
    logs = views.audit_logs(spark, d)
    subjects = {"document": views.documents(spark, d, status=False).select(F.col("id").alias("auditable_id"), F.col("name").alias("subject")), "user": views.users(spark, d).select(F.col("id").alias("auditable_id"), F.col("full_name").alias("subject"))}
    parts = [logs.where(F.col("auditable_type") == t).join(s, "auditable_id").select("id", "action", "auditable_type", "subject") for t, s in subjects.items()]
    return parts[0].unionByName(parts[1])
