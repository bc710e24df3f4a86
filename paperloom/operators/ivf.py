"""Approximate vector index: a coarse quantiser, lists of vectors by cell, probes that read only their cells.

Centres are k-means of a bounded sample; every vector goes to the list of its nearest centre, with the list's radius (the
widest angle between the centre and a member). A query looks into the cells whose centres are nearest. By the radii, no
member of a cell is nearer to the query than the angle to its centre less the radius, so a search can also be exact: what
the first probes found proves other cells out, and only the rest is read.

Lists are dealt into groups of about ``GROUP_ROWS`` members. A group's members come to their task first, then the queries
that ask for its cells stream past in batches, a row for each query and group. A batch is scored against a list by a matrix
product in single precision, whose error has a bound; what can be among the best by that bound, and nothing else, is scored
exactly and leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store

#: Rows that centres are fitted on at most, rounds of fitting, and cells a query reads unless a caller says otherwise.
SAMPLE, ROUNDS, PROBES = 50_000, 12, 8
#: Members of a list that one group takes at most (about); longer lists are dealt out in parts.
LIST_ROWS = 2048
#: Members that a task holds at once (about), and queries that are scored against them together.
GROUP_ROWS, BATCH = 8192, 256
#: What rounding can do to an angle.
_SLACK = 1e-6


class Index(NamedTuple):
    """``lists`` (id, unit, part, cell) by cell in folders; ``cells`` (cell, centre, size, radius, parts), a row a list."""

    spark: SparkSession
    path: str
    cells: DataFrame

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema("id long, unit array<double>, part long, cell int").parquet(f"{self.path}/lists")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def units(vectors: DataFrame) -> DataFrame:
    """``id, unit``: vectors at length 1. Null, empty and zero vectors and those with a part that is no finite number have none."""
    v = F.col("embedding").cast("array<double>")
    whole = F.size(v) > 0
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    out = vectors.select("id", v.alias("v"), norm.alias("norm")).where(whole & (F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return out.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, path: str | None = None) -> Index:
    """An index of ``vectors`` (id, embedding) in the shared folder; all rows that have a direction are in it.

    ``lists`` is the number of cells, by default the root of the number of rows. Centres are fitted on the ``sample`` rows
    whose ids hash least; assignment, radii and sizes are of all rows. An empty table gives an index without cells.
    """
    spark = vectors.sparkSession
    path = path or store.shared_folder(spark, "ivf")
    rows = store.kept(units(vectors), f"{path}/units")
    total = rows.count()
    wanted = lists or max(1, math.isqrt(total))
    fitted = rows.where(F.shiftrightunsigned(F.xxhash64("id"), 11) / (1 << 53) <= min(1.0, 2 * sample / max(total, 1))).orderBy(F.xxhash64("id"), "id").limit(sample).repartition(spark.sparkContext.defaultParallelism)
    features = array_to_vector("unit").alias("features")
    if total:
        model = KMeans(k=max(2, wanted), maxIter=ROUNDS, seed=7, distanceMeasure="cosine").fit(fitted.select(features))
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
        found = store.kept(model.setPredictionCol("cell").transform(rows.select("id", "unit", features)).drop("features"), f"{path}/found")
    else:
        centres, found = spark.createDataFrame([], "cell int, centre array<double>"), rows.withColumn("cell", F.lit(0))
    length = F.sqrt(_dot(F.col("centre"), F.col("centre")))
    centres = centres.withColumn("length", length).select("cell", F.transform("centre", lambda x: x / F.col("length")).alias("centre"))
    # sizes and radii are partial aggregations; the centres are a row a cell
    told = found.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.count("*").alias("size"), F.max(_angle(_dot(F.col("unit"), F.col("centre")))).alias("radius"))
    parts = F.ceil(F.col("size") / LIST_ROWS).cast("long").alias("parts")
    cells = store.kept(centres.join(told, "cell").select("cell", "centre", "size", "radius", parts), f"{path}/cells")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    dealt = found.join(F.broadcast(cells.select("cell", "parts")), "cell").select("id", "unit", part, "cell")
    dealt.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/lists")
    for table in ("units", "found"):
        store.drop(spark, f"{path}/{table}")
    return Index(spark, path, cells)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


class _Cells(NamedTuple):
    """The table of cells as arrays, by cell: the root of the vectors' number of rows. Slots are the lists' parts, by group."""

    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    slot_cell: np.ndarray
    slot_part: np.ndarray
    slot_group: np.ndarray

    @property
    def dim(self) -> int:
        return self.centre.shape[1]

    def slots(self, spark: SparkSession) -> DataFrame:
        rows = zip(self.cell[self.slot_cell].tolist(), self.slot_part.tolist(), self.slot_group.tolist(), strict=True)
        return spark.createDataFrame(list(rows), "cell int, part long, group int")

    def angles(self, queries: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(queries @ self.centre.T, -1.0, 1.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _cells(index: Index) -> _Cells:
    found = index.cells.orderBy("cell").toArrow().combine_chunks()
    cell, size, radius, parts = (found[c].to_numpy() for c in ("cell", "size", "radius", "parts"))
    centres = found["centre"].combine_chunks()
    centre = _matrix(centres, len(centres[0]) if len(centres) else 0)
    at = np.repeat(np.arange(len(cell)), parts)
    part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    rows = (size / parts)[at]
    # groups are alike in size, within half a part
    groups, middle = max(1, math.ceil(rows.sum() / GROUP_ROWS)), np.cumsum(rows) - rows / 2
    group = np.minimum(groups - 1, middle * groups // max(rows.sum(), 1)).astype(int)
    return _Cells(cell, centre, radius, parts, at, part, group)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; tasks drop what is beyond k before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


class _Group:
    """The members of a group's lists, and their answers to batches of queries: the k best of each, or all if k is None."""

    def __init__(self, pieces: list[pa.RecordBatch], k: int | None):
        rows = pa.Table.from_batches(pieces).combine_chunks()
        ids, cells, unit = (rows[c].combine_chunks() for c in ("id", "cell", "unit"))
        dim, self.k = len(unit[0]), k
        cells, units, known, order = cells.to_numpy(), _matrix(unit, dim), ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        if k is not None:
            # of equal vectors only the k smallest ids can be among a query's k best
            _, same = np.unique(np.ascontiguousarray(units).view(np.dtype((np.void, units.itemsize * dim))).ravel(), return_inverse=True)
            keep = np.sort((by := np.lexsort((order, known, same)))[_places(same[by]) < k])
            ids, cells, units, known, order = ids.take(pa.array(keep)), cells[keep], units[keep], known[keep], order[keep]
        self.ids, self.known, self.order = ids, known, order
        self.coarse, self.columns = units.astype(np.float32), np.ascontiguousarray(units.T)
        starts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
        self.cells, self.ranges = cells[starts], list(zip(starts, [*starts[1:], len(cells)], strict=True))
        #: Twice what single precision can do to a sum of ``dim`` products of vectors of length 1, and to their parts.
        self.slack = np.float32((dim + 8) * 2.0**-23)

    def answer(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        queries = _matrix(batch.column("unit"), len(self.columns))
        coarse, asked = queries.astype(np.float32), np.zeros((len(queries), len(self.cells)), bool)
        lists = batch.column("cells")
        wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(queries)), pc.list_value_length(lists).to_numpy())
        at = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        asked[who, at] = self.cells[at] == wanted
        low = batch.column("worst").fill_null(-np.inf).to_numpy().astype(np.float32) - self.slack
        members, askers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, (a, b) in enumerate(self.ranges):
            who = np.flatnonzero(asked[:, c])
            if len(who):
                scores = self.coarse[a:b] @ coarse[who].T
                if self.k is not None and b - a > self.k and np.isinf(low[who]).any():
                    low[who] = np.maximum(low[who], np.partition(scores, b - a - self.k, axis=0)[b - a - self.k] - self.slack)
                m, j = np.nonzero(scores >= low[who])
                members.append(m + a)
                askers.append(who[j])
        m, j = np.concatenate(members), np.concatenate(askers)
        # in the order of components, so that equal vectors have equal similarities wherever they are
        exact = np.zeros(len(m))
        for mine, its in zip(self.columns, np.ascontiguousarray(queries.T), strict=True):
            exact += mine[m] * its[j]
        by = np.lexsort((self.order[m], self.known[m], -exact, j))
        if self.k is not None:
            by = by[_places(j[by]) < self.k]
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(j[by])), self.ids.take(pa.array(m[by])), pa.array(exact[by])], ["query_id", "id", "similarity"])


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys, from 0."""
    at = np.arange(len(keys))
    first = np.diff(keys, prepend=keys[0] - 1) != 0 if len(keys) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _searcher(k: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by group, its members first and by cell, then the queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, held = None, [], None
        for batch in batches:
            groups, kinds = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(groups)], strict=True):
                if a == b:
                    continue
                if groups[a] != at:
                    at, pieces, held = groups[a], [], None
                if kinds[a] == 0:
                    pieces.append(batch.slice(a, b - a))
                elif pieces or held:
                    held, pieces = held or _Group(pieces, k), []
                    for i in range(a, b, BATCH):
                        yield held.answer(batch.slice(i, min(BATCH, b - i)))

    return search


def _answers(index: Index, slots: DataFrame, asked: DataFrame, wanted: DataFrame, k: int | None) -> DataFrame:
    """``query_id, id, similarity``: members of the cells that are asked for in a group (``query_id, query, group, cells, worst``).

    With k, the k best of a query and group at ``worst`` or above, which may be null. ``wanted`` has all asked cells; other
    lists are not read.
    """
    read = slots.join(F.broadcast(wanted.where("cell >= 0")), "cell", "left_semi")
    members = index.lists.join(F.broadcast(read), ["cell", "part"])
    members = members.select("group", F.lit(0).alias("kind"), "cell", "id", "unit", F.lit(None).cast("array<int>").alias("cells"), F.lit(None).cast("double").alias("worst"))
    queries = asked.select("group", F.lit(1).alias("kind"), F.col("cells")[0].alias("cell"), F.col("query_id").cast("long").alias("id"), F.col("query").alias("unit"), "cells", "worst")
    dealt = members.union(queries).repartition("group").sortWithinPartitions("group", "kind", "cell", "id")
    return dealt.mapInArrow(_searcher(k), "query_id long, id long, similarity double")


def _scored(index: Index, probes: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, id, similarity`` of all members of the probed cells (``query_id, query, cell``, a row a cell); with k, of the
    k best of each query and group at least."""
    slots = _cells(index).slots(index.spark)
    placed = probes.select("query_id", "query", "cell").join(F.broadcast(slots.select("cell", "group").distinct()), "cell")
    asked = placed.groupBy("query_id", "group").agg(F.first("query").alias("query"), F.sort_array(F.collect_set("cell")).alias("cells"), F.lit(None).cast("double").alias("worst"))
    return _answers(index, slots, asked, probes.select("cell").distinct(), k)


def _ranked_cells(index: Index, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """``query_id, query, cell, parts, turn``: every query's cells, nearest first, or the ``probes`` nearest of them."""
    cells = _cells(index)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), BATCH):
                batch = whole.slice(i, BATCH)
                order = np.argsort(cells.angles(_matrix(batch.column("query"), cells.dim)), axis=1, kind="stable")[:, :probes]
                who, at = pa.array(np.repeat(np.arange(len(batch)), order.shape[1])), order.ravel()
                turns = np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(batch))
                columns = [batch.column("query_id").take(who), batch.column("query").take(who), pa.array(cells.cell[at]), pa.array(cells.parts[at]), pa.array(turns)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "query", "cell", "parts", "turn"])

    near = units(queries).where(F.size("unit") == cells.dim).select(F.col("id").cast("long").alias("query_id"), F.col("unit").alias("query"))
    return near.mapInArrow(ranked, "query_id long, query array<double>, cell int, parts long, turn int")


def _open_cells(cells: _Cells, near: DataFrame) -> DataFrame:
    """``query_id, group, cells``: by group, the cells beyond ``seen`` whose bound reaches ``worst`` (all, if that is null)."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), BATCH):
                batch = whole.slice(i, BATCH)
                angle = cells.angles(_matrix(batch.column("query"), cells.dim))
                bound = np.cos(np.maximum(0.0, angle - cells.radius - _SLACK)) + _SLACK
                open_ = bound >= batch.column("worst").fill_null(-2.0).to_numpy()[:, None]
                seen = batch.column("seen")
                open_[np.repeat(np.arange(len(batch)), pc.list_value_length(seen).to_numpy()), np.searchsorted(cells.cell, seen.flatten().to_numpy())] = False
                # slots stand by group, so a query's slots of a group are neighbours
                who, slot = np.nonzero(open_[:, cells.slot_cell])
                groups = cells.slot_group[slot].astype(np.int32)
                starts = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(groups, prepend=-1) != 0))
                listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(who)), pa.int32()), pa.array(cells.cell[cells.slot_cell[slot]]))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(who[starts])), pa.array(groups[starts]), listed], ["query_id", "group", "cells"])

    return near.mapInArrow(opened, "query_id long, group int, cells array<int>")


def top_k(index: Index, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """``query_id, rank, id, similarity``: the k most similar rows for each of ``queries`` (id, embedding).

    Equal similarities go by id; rows without a direction are found by nobody, and queries without one find nothing.
    Queries have ids of their own. With ``exact`` all cells are read
    whose bound reaches the k-th similarity of the first probes, so nothing is missed; without, the nearest ``probes``.
    """
    if not exact:
        return _best(_scored(index, _ranked_cells(index, queries, probes), k), k)
    path = store.shared_folder(index.spark, "ivf-search")
    ranked = store.kept(_ranked_cells(index, queries, probes), f"{path}/ranked")
    first = store.kept(_best(_scored(index, ranked, k), k), f"{path}/first")
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("worst"))
    near = ranked.groupBy("query_id").agg(F.first("query").alias("query"), F.collect_list("cell").alias("seen")).join(worst, "query_id", "left")
    near, cells = store.kept(near, f"{path}/near"), _cells(index)
    # a row a query and group, without the query's vector
    rest = store.kept(_open_cells(cells, near), f"{path}/rest")
    asked = rest.join(near.drop("seen"), "query_id")
    more = _answers(index, cells.slots(index.spark), asked, rest.select(F.explode("cells").alias("cell")).distinct(), k)
    return _best(first.drop("rank").unionByName(more), k)


def probes_for(index: Index, queries: DataFrame, k: int, recall: float = 0.95, most: int = 200) -> int:
    """The number of probes at which ``most`` of ``queries`` at most, those whose ids hash least, find ``recall`` of their k best.

    Their exact lists say in which turn each neighbour's cell comes; the answer is the quantile of those turns. Measured
    on the index and vectors at hand: directions without clusters need many cells, clustered ones few.
    """
    few = queries.orderBy(F.xxhash64("id"), "id").limit(most)
    true = top_k(index, few, k, exact=True).select("query_id", "id")
    turns = _ranked_cells(index, few).select("query_id", "cell", "turn")
    asked = true.join(index.lists.select("id", "cell"), "id").join(turns, ["query_id", "cell"])
    found = asked.agg(F.percentile("turn", recall).alias("p")).first().p
    return max(1, math.ceil(found)) if found is not None else PROBES
