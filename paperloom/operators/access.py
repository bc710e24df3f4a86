"""Who sees what: tenants, roles, and row-level security of reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CLASSIFICATIONS, REVIEWERS, ROLES_BY_CLASSIFICATION, allowed_classifications


#: Rows of a key that a task of ``join_spread`` takes (about), and the most keys that it deals out to several tasks.
KEY_ROWS, SPREAD_KEYS = 100_000, 1000


class Caller(NamedTuple):
    """The user on whose behalf a query runs, with the workspace that they are in."""

    id: int
    role: str
    workspace_id: str | None = None
    personal: bool = False


def one_of(c: Column, values) -> Column:
    """Membership; of an empty list nothing is a member, and Spark then reads no table."""
    return c.isin(*values) if values else F.lit(False)


def of_tenant(df: DataFrame, workspace_id: str | None, null_safe: bool = True) -> DataFrame:
    """Rows of a workspace. Null-safe, a caller without one sees rows without one; else they see nothing."""
    mine = F.lit(workspace_id).cast("string")
    return df.where(F.col("workspace_id").eqNullSafe(mine) if null_safe else F.col("workspace_id") == mine)


def visible(docs: DataFrame, caller: Caller, search: bool = False) -> DataFrame:
    """Documents that a caller's lists and dashboards show; with ``search``, those that searches draw from.

    In a personal workspace searches are of the caller's own documents, lists show all of the workspace.
    """
    mine = of_tenant(docs, caller.workspace_id, null_safe=not search)
    if caller.personal:
        return mine.where(F.col("uploaded_by") == caller.id) if search else mine
    return mine.where(one_of(F.col("classification"), allowed_classifications(caller.role)))


def role_allows(role: Column, classification: Column) -> Column:
    allowed = F.lit(False)
    for c in CLASSIFICATIONS:
        allowed = F.when(classification == c, role.isin(*ROLES_BY_CLASSIFICATION[c])).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def may_view(personal: Column, uploader: Column, workspace: Column, classification: Column, user: Column, role: Column, current: Column) -> Column:
    """The single-document policy: owners in personal workspaces, else the same workspace and a sufficient role."""
    own = F.coalesce(uploader == user, F.lit(False))
    return F.when(F.coalesce(personal, F.lit(False)), own).otherwise(workspace.eqNullSafe(current) & role_allows(role, classification))


def may_review(view: Column, personal: Column, role: Column) -> Column:
    """Approve, reject and reprocess: what may be viewed, by reviewers, or by the owner of a personal workspace."""
    return view & (F.coalesce(personal, F.lit(False)) | role.isin(*REVIEWERS))


def secured(view: DataFrame, credentials: DataFrame, db_role: str) -> DataFrame:
    """Rows of a report for a database role: of the workspace that its one valid credential names; more than one is an error."""
    own = credentials.where((F.col("db_role") == db_role) & F.col("revoked_at").isNull()).select("workspace_id")
    return view.where(F.col("workspace_id") == own.scalar())


def remaining_admins(users: DataFrame, but: int) -> DataFrame:
    """How many active administrators there are besides one; at 0 that one must stay."""
    return users.where(F.col("active") & (F.col("role") == "Administrator") & (F.col("id") != but)).agg(F.count("*").alias("n"))


def join_spread(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """``rows`` with the ``others`` of an equal key (null with null), where few keys may hold most rows.

    The ``SPREAD_KEYS`` keys with the most rows, a list of that bound, have their rows dealt out to a task for every
    ``KEY_ROWS`` of them, and the others of such a key go to each of these tasks. Any further key has at most one in
    ``SPREAD_KEYS`` of all rows.
    """
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > KEY_ROWS)
    spread = F.broadcast(counts.orderBy(F.desc("_rows")).limit(SPREAD_KEYS).select("_key", F.ceil(F.col("_rows") / KEY_ROWS).alias("_parts")))

    def parted(df: DataFrame, by: str) -> DataFrame:
        return df.join(spread, F.col(by).eqNullSafe(F.col("_key")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long"))).drop("_key")

    dealt = parted(rows, key).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).drop("_parts")
    copied = parted(others, other_key).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copied, F.col(key).eqNullSafe(F.col(other_key)) & (F.col("_part") == F.col("_copy"))).drop("_part", "_copy")
