"""Joins of users with documents where one workspace holds most of them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.operators import access
from paperloom.plans.access import caller


@pytest.fixture
def tables(spark):
    # two thirds in one workspace, some in none; rows that repeat, uploaders in other workspaces, without a user, null
    docs = [(i // 2, "big" if i % 3 else [None, "home", "own", "unknown"][i // 3 % 4], ["Public", "Internal", "Restricted"][i % 3], [1, 2, 3, 9, None][i % 5]) for i in range(200)]
    users = [(1, "Administrator", "big"), (2, "Viewer", "big"), (3, "Reviewer", None), (4, "Analyst", "own"), (5, "Owner", "empty")]
    spaces = [("big", "Organization"), ("home", "Organization"), ("own", "Personal"), ("empty", "Organization")]
    frames = [(docs, "id long, workspace_id string, classification string, uploaded_by long"), (users, "id long, role string, current_workspace_id string"), (spaces, "id string, type string")]
    return docs, users, [spark.createDataFrame(*f) for f in frames]


@pytest.mark.parametrize("rows,keys", [(access.KEY_ROWS, access.SPREAD_KEYS), (7, 1000), (7, 1)])
def test_users_meet_documents_of_large_workspaces(tables, monkeypatch, rows, keys):
    """The pairs are those of a plain loop, whether no key, all large keys or only the largest is dealt out."""
    monkeypatch.setattr(access, "KEY_ROWS", rows)
    monkeypatch.setattr(access, "SPREAD_KEYS", keys)
    docs, users, (d, u, w) = tables
    want = Counter((i, user) for i, space, _, by in docs for user, _, current in users if space == current or by == user)
    got = caller(u, d, w)
    assert Counter((r.id, r.user_id) for r in got.collect()) == want
    assert caller(u, d.where("false"), w).count() == caller(u.where("false"), d, w).count() == 0


def test_a_large_workspace_goes_to_many_tasks(tables, spark, monkeypatch):
    monkeypatch.setattr(access, "KEY_ROWS", 500)
    spark_rows = spark.range(10_000).select("id", F.lit("big").alias("workspace_id"))
    people = spark.createDataFrame([(1, "big"), (2, "big"), (3, "small")], "user_id long, current_workspace_id string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("16", "-1", "false"), strict=True):
            spark.conf.set(k, v)
        sizes = [r["count"] for r in access.join_spread(spark_rows, people, "workspace_id", "current_workspace_id").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and len(sizes) > 6 and max(sizes) < 10_000
