"""The index of cells: exact against all pairs, its recall, what it reads, and odd vectors."""

import numpy as np
import pytest

from paperloom.operators import ivf


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>")


def plain(vectors, queries, k):
    ids = [i for i, v in enumerate(vectors) if v is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    m = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    out = {}
    for q in queries:
        if q in ids:
            s = m @ (vectors[q] / np.linalg.norm(vectors[q]))
            out[q] = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-round(s[i], 12), ids[i]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (30, 24))
    vectors = [centres[i % 30] + rng.normal(0, 0.35, 24) for i in range(3000)]
    vectors[7], vectors[8], vectors[9], vectors[10] = None, np.zeros(24), np.full(24, np.nan), vectors[11]
    vectors[12] = np.array([np.inf] + [0.0] * 23)
    return vectors


def test_exact_and_recall(spark, clustered, monkeypatch):
    monkeypatch.setattr(ivf, "LIST_ROWS", 40)  # lists of several parts
    index = ivf.build(frame(spark, clustered), lists=40, sample=1000)
    assert index.cells.agg({"size": "sum"}).first()[0] == 2996 and index.lists.select("id").distinct().count() == 2996
    queries = frame(spark, clustered).where("id % 50 = 0 OR id < 15")
    want = plain(clustered, [r.id for r in queries.select("id").collect()], 10)
    assert found(ivf.top_k(index, queries, 10, probes=1, exact=True)) == want
    got = found(ivf.top_k(index, queries, 10, probes=6))
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) > 0.9


def test_probes_read_only_their_cells(spark, clustered):
    index = ivf.build(frame(spark, clustered), lists=20)
    cell = index.cells.orderBy("cell").first().cell
    probes = spark.createDataFrame([(1, [1.0] * 24, cell, 1)], "query_id long, query array<double>, cell int, parts long")
    plan = ivf._scored(index, probes)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(cell" in plan
    assert ivf._scored(index, probes).count() == index.cells.where(f"cell = {cell}").first()["size"]


def test_few_and_no_vectors(spark):
    few = frame(spark, [np.array([1.0, 0.0]), np.array([0.0, 2.0]), np.array([1.0, 0.0])])
    assert found(ivf.top_k(ivf.build(few, lists=2), few, 5, probes=1, exact=True)) == {0: [0, 2, 1], 1: [1, 0, 2], 2: [0, 2, 1]}
    none = few.where("false")
    assert ivf.top_k(ivf.build(none), few, 5, exact=True).count() == 0 and ivf.top_k(ivf.build(few), none, 5).count() == 0


def test_probes_that_reach_a_recall(spark, clustered):
    """Fitted on some queries, measured on others: clustered vectors, and the given ones, which have no clusters."""
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    for rows in (frame(spark, clustered), given):
        index = ivf.build(rows)
        probes = ivf.probes_for(index, rows.where("id % 50 = 1"), 10)
        pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
        queries = rows.where("id % 50 = 0")
        want = pairs(ivf.top_k(index, queries, 10, exact=True))
        assert len(want & pairs(ivf.top_k(index, queries, 10, probes=probes))) / len(want) >= 0.9


def most_rows(df):
    """The most rows that an operator of the executed plan gave to the next."""

    def walk(node):
        own = [m.get().value()] if (m := node.metrics().get("numOutputRows")).isDefined() else []
        below = [node.children().apply(i) for i in range(node.children().size())]
        name = node.getClass().getSimpleName()
        below += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        return max([0, *own, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_search_makes_no_row_a_pair(spark):
    """Without clusters no cell is proved out, so every query is scored against every vector; only possible answers become rows."""
    vectors = list(np.random.default_rng(3).normal(0, 1, (6000, 16)))
    rows = frame(spark, vectors).cache()
    queries = rows.where("id % 20 = 0")
    got = ivf.top_k(ivf.build(rows), queries, 10, exact=True)
    assert found(got) == plain(vectors, range(0, 6000, 20), 10)
    got.collect()
    assert 3000 <= most_rows(got) < 6000 * 300 / 20


def test_copies_over_many_groups(spark, monkeypatch):
    """One vector in most rows, in parts and groups of a few rows, ties by id; a query's list is the smallest ids."""
    monkeypatch.setattr(ivf, "LIST_ROWS", 40)
    monkeypatch.setattr(ivf, "GROUP_ROWS", 100, raising=False)
    rng = np.random.default_rng(4)
    vectors = [v if i % 3 else np.arange(1.0, 9.0) for i, v in enumerate(rng.normal(0, 1, (900, 8)))]
    index = ivf.build(frame(spark, vectors), lists=6)
    queries = frame(spark, vectors).where("id % 25 = 0")
    want = plain(vectors, range(0, 900, 25), 10)
    assert want[0] == list(range(0, 30, 3))
    assert found(ivf.top_k(index, queries, 10, probes=2, exact=True)) == want
    # more asked for than there are
    every = ivf.top_k(index, queries.where("id < 50"), 1000, probes=1, exact=True)
    assert every.groupBy("query_id").count().select("count").distinct().collect() == [(900,)]


def test_odd_queries(spark, clustered):
    """Rows without an id are in the index and found; queries of another length, or without a direction, find nothing."""
    some = frame(spark, clustered[20:220])
    nameless = spark.createDataFrame([(None, [float(x) for x in clustered[20]])], some.schema)
    index = ivf.build(some.union(nameless), lists=5)
    asked = frame(spark, [clustered[20], np.ones(3), np.zeros(24), None], first=5000)
    assert found(ivf.top_k(index, asked, 3, probes=1, exact=True))[5000][:2] == [None, 0]
    assert set(found(ivf.top_k(index, asked, 3, probes=1))) == {5000}
