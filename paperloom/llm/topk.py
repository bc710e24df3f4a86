"""Exact top-k by integer inner product: an impact-ordered index, processed score at a time.

Vectors are dealt into shards of about ``SHARD``, each once. A shard's vectors come to their task first, then all queries
stream past them in batches, so a task holds a shard and a batch and nothing that grows with the table. A shard's index
has a posting list for each dimension, ordered by descending absolute value and cut into segments of ``SEGMENT``
postings. Queries of a batch are alike in their greatest dimension. Segments are processed by descending quantised
impact (the segment's greatest value times the greatest component of the queries that are still open); every posting
adds its contribution to the accumulators of these queries.

What a vector's unprocessed dimensions can still add is at most the product of the norms of the query's and the
vector's remaining parts (Cauchy-Schwarz). The k-th best of a few vectors scored exactly at the start is a first
threshold, and lower bounds raise it. When these bounds prove that all but a few vectors are below it, a query is
closed: every possible member is scored exactly from its whole vector. Without proof it goes on to the last segment,
where accumulators are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

SHARD, SEGMENT, BATCH = 8192, 2048, 64
#: Vectors scored at the start, looks at the bounds, the share of the segments before the first, and the share of a shard
#: that may be left to exact scoring.
SEED, LOOKS, FIRST, FEW = 512, 8, 0.5, 0.02
#: Levels of quantised impact.
LEVELS = 256


class ShardIndex:
    """Posting segments of a shard's dimensions by descending absolute value. ``read`` counts postings by query, of ``whole``."""

    def __init__(self, vectors: np.ndarray, segment: int = SEGMENT):
        self.vectors = vectors
        order = np.argsort(-np.abs(vectors), axis=0, kind="stable")
        self.segments = []
        for d in range(vectors.shape[1]):
            for i in range(0, len(vectors), segment):
                ids = order[i : i + segment, d]
                values = vectors[ids, d]
                self.segments.append((d, ids, values, float(np.abs(values[0]))))
        self.dims = np.array([s[0] for s in self.segments])
        self.greatest = np.array([s[3] for s in self.segments])
        self.squares = (vectors**2).sum(axis=1)
        self.read = self.whole = 0

    def order(self, queries: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The segments ``left`` by descending quantised impact on the queries."""
        impact = np.abs(queries).max(axis=0)[self.dims[left]] * self.greatest[left]
        level = np.floor(impact * (LEVELS / max(float(impact.max()), 1e-9)))
        return left[np.argsort(-level, kind="stable")]

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the places and exact scores of every vector that may be among its k best, ``own`` (a mask) apart.

        All vectors that tie with the k-th are among them. Sums are of whole numbers that the vectors' type holds exactly.
        """
        n, m = len(self.vectors), len(queries)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * m
        seed = np.where(own[:SEED], -np.inf, self.vectors[:SEED] @ queries.T)
        least = np.sort(seed, axis=0)[-k] if len(seed) >= k else np.full(m, -np.inf)
        open_, left = np.arange(m), self.order(queries, np.arange(len(self.segments)))
        acc = np.zeros((n, m), self.vectors.dtype)
        unseen, rest, squares = np.ones_like(self.vectors), self.squares.copy(), (queries**2).T.copy()
        self.whole += m * n * self.vectors.shape[1]
        step = max(1, int(len(left) * FIRST))
        while len(open_):
            for s in left[:step]:
                d, ids, values, _ = self.segments[s]
                acc[ids] += np.outer(values, queries[:, d])
                unseen[ids, d] = 0
                rest[ids] -= values**2
                self.read += len(ids) * len(open_)
            left, step = left[step:], max(1, len(self.segments) // LOOKS)
            # half a point above the bound, as norms are rounded and scores are whole
            slack = np.sqrt(np.maximum(rest, 0)[:, None] * (unseen @ squares)) * 1.0001 + 0.5 if len(left) else np.zeros_like(acc)
            lower = np.where(own, -np.inf, acc - slack)
            if n > k:
                least = np.maximum(least, np.partition(lower, n - k, axis=0)[n - k])
            maybe = ~own & (acc + slack >= least)
            closed = (maybe.sum(axis=0) <= max(2 * k, FEW * n)) if len(left) else np.ones(len(open_), bool)
            for j in np.flatnonzero(closed):
                at = np.flatnonzero(maybe[:, j])
                out[open_[j]] = at, self.vectors[at] @ queries[j]
            if closed.any():
                keep = ~closed
                open_, queries, least, own = open_[keep], queries[keep], least[keep], own[:, keep]
                acc, squares = np.ascontiguousarray(acc[:, keep]), np.ascontiguousarray(squares[:, keep])
                if len(open_):
                    left = self.order(queries, left)
        return out


FOUND = "query_id long, vec_id long, score long"


class Shard:
    """The vectors of a shard and their answers to batches of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.greatest, self.indexes = int(np.abs(vectors).max(initial=0)), {}

    def answer(self, ids: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        out_q, out_v, out_s = [], [], []
        if len(self.ids) and self.vectors.shape[1]:
            most = self.greatest * int(np.abs(queries).max(initial=0)) * self.vectors.shape[1]
            square = max(self.greatest, int(np.abs(queries).max(initial=0))) ** 2 * self.vectors.shape[1]
            # floats hold whole sums below 2 ** 24, doubles below 2 ** 53; beyond, Python's own integers are exact
            kind = np.float32 if square < 1 << 23 else np.float64 if square < 1 << 52 else object
            if most >= 1 << 63:
                raise OverflowError("scores are beyond 64 bits")
            own = self.ids[:, None] == ids
            if kind is object:
                whole = self.vectors.astype(object)
                found = [((at := np.flatnonzero(~own[:, j])), (whole[at] @ q.astype(object)).astype(np.int64)) for j, q in enumerate(queries)]
            else:
                if kind not in self.indexes:
                    self.indexes[kind] = ShardIndex(self.vectors.astype(kind))
                found = self.indexes[kind].top(queries.astype(kind), self.k, own)
            for j, (places, scores) in enumerate(found):
                order = np.lexsort((self.ids[places], -scores))[: self.k]
                out_q.append(np.full(len(order), ids[j])), out_v.append(self.ids[places[order]]), out_s.append(scores[order].astype(np.int64))
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_q, out_v, out_s)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in FOUND.split(", ")])


def searcher(k: int):
    """Rows come by shard (dim, shard), a shard's vectors first and then all queries, those of one greatest dimension together."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, ids, rows = None, None, [], []

        def matrix() -> np.ndarray:
            return np.array(rows, np.int64).reshape(len(rows), at[0])

        def asked() -> Iterator[pa.RecordBatch]:
            if rows and shard:
                yield shard.answer(np.array(ids, np.int64), matrix())

        for batch in batches:
            dims, shards, kinds, vec_ids = (batch.column(i).to_pylist() for i in range(4))
            vectors = batch.column(4)
            for i, place in enumerate(zip(dims, shards, strict=True)):
                if place != at:
                    yield from asked()
                    at, shard, ids, rows = place, None, [], []
                if kinds[i] and not shard:
                    shard, ids, rows = Shard(np.array(ids, np.int64), matrix(), k), [], []
                ids.append(vec_ids[i])
                rows.append(vectors[i].values.to_numpy(zero_copy_only=False))
                if shard and len(rows) == BATCH:
                    yield from asked()
                    ids, rows = [], []
        yield from asked()

    return search


def quantised(embedding: Column) -> Column:
    """``floor(64 * x)`` of every component, as a double's; null where a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * 64).cast("long")))


def top_k(embeddings: DataFrame, k: int = 20, is_query: Column | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other vectors for each query of ``embeddings`` (vec_id, embedding).

    Queries are the rows that fit ``is_query``, by default those with an id divisible by 20. Equal scores go to the
    smaller id. Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Rows
    that repeat a vec_id with one vector are one; with other vectors, each takes part, but none for its own id. Vectors
    of another length are no candidates. Other columns are not used. An empty table gives an empty result. Scores are
    exact at any size; beyond 64 bits they are an error.
    """
    scratch = Scratch(embeddings.sparkSession)
    chosen = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    all_ = embeddings.select("vec_id", quantised(F.col("embedding")).alias("v"), F.coalesce(chosen, F.lit(False)).alias("q")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    all_ = scratch.write(all_.groupBy(F.col("vec_id").cast("long").alias("vec_id"), "v").agg(F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    shards = max(1, -(-all_.count() // SHARD))
    first = F.lit(None).cast("int")
    vectors = all_.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", first.alias("lead"))
    sizes = F.transform("v", lambda x: F.abs(x))
    lead = F.array_position(sizes, F.array_max(sizes)).cast("int")
    queries = all_.where("q").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", lead.alias("lead"))
    dealt = vectors.union(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "lead", "vec_id")
    found = dealt.mapInArrow(searcher(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
