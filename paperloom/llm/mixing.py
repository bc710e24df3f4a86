"""Mixing sources to target weights, by DataFrame operations only.

Each document gets a hash-random key, of its id and text. Within its source, documents are sorted by key; the running sum
of their sizes says where the mix cuts the source. The sum is a distributed prefix sum: the key space of a source is
dealt into as many equal ranges as the square root of the largest source's number of documents (a range partitioning, as
keys are uniform), range totals are summed first, the totals' running sum gives each range its offset, and only then does
each range sum its own documents. So no task orders more than about that root: a range, or the ranges of a source.

Rows that are alike in source, id and text are one row with a count in all of this, and numbered only at the end. Texts
are read once for sizes and keys. The mix itself joins what it takes of each document to the documents by key, so that
texts are neither sorted nor dealt out by range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Salted, Scratch

#: The most rows that one row with a count becomes in one place.
ALIKE_ROWS = 10_000
#: Weights by the rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: Size of the mix as a share of all sizes, and the most epochs of a source.
SHARE, EPOCHS = 1.5, 2


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source (source, source_size): its target, at most ``epochs`` times its size, the excess dealt again by weight.

    The end of dealing again and again is water at one level: a source gets ``min(cap, level * weight)``. Sources
    sorted by ``cap / weight`` are full up to some rank, and the level follows from those that are not. The table has
    one row a source, so its window without keys is over a handful of rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    dealt = F.array(*[F.lit(w) for w in weights])
    caps = sizes.withColumn("w", F.element_at(dealt, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    caps = caps.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    ranked = caps.withColumn("level", level)
    # full sources are those whose own level, with all smaller ones full, is at their cap or above
    open_level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    return ranked.withColumn("target", F.when(F.col("level") >= F.col("full_at"), F.col("cap")).otherwise(open_level * F.col("w"))).select("source", "source_size", "target")


def _key(seed: str) -> Column:
    """Random by id and text, so that documents without an id, or with one id, are spread as others are."""
    part = lambda c, none: F.coalesce(c, F.lit(none))
    return F.md5(F.concat(F.lit(seed + ":"), part(F.col("doc_id").cast("string"), "null"), F.lit(":"), part(F.md5(F.col("text").cast("string").cast("binary")), "null")))


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def _slim(docs: DataFrame, size: Column | None, seed: str) -> DataFrame:
    whole = words(F.col("text").cast("string")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    return docs.select("doc_id", _source().alias("src"), whole.alias("size"), _key(seed).alias("key"))


def _placed(scratch: Scratch, slim: DataFrame) -> DataFrame:
    """``doc_id, src, key, size`` of ``slim`` (a table) with the number ``alike`` of its rows, source_size, target, epochs and ``left``.

    ``left`` are the words of the last epoch that are left for the first of the rows; each one takes its size of them.
    """
    most = slim.groupBy("src").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 1
    ranges = math.isqrt(most) + 1
    # eight hex digits of the key as a fraction: ranges of it are in the order of keys
    keyed = slim.withColumn("range", F.expr(f"CAST(conv(substring(key, 1, 8), 16, 10) AS BIGINT) * {ranges} DIV {1 << 32}"))
    per_range = scratch.write(keyed.groupBy("src", "range").agg(F.sum("size").alias("range_size")), "ranges")
    sizes = per_range.groupBy("src").agg(F.sum("range_size").alias("source_size"))
    goal = targets(sizes.select(F.when(F.col("src") != "null", F.substring("src", 2, 2**31 - 1)).alias("source"), "source_size"))
    goal = goal.select(_source().alias("src"), "source_size", "target")
    upto = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("src", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("offset")).join(goal, "src")
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = keyed.groupBy("src", "range", "key", "doc_id", "size").agg(F.count("*").alias("alike"))
    placed = groups.join(offsets, ["src", "range"]).withColumn("start", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("alike")).over(inside), F.lit(0)))
    placed = placed.withColumn("epochs", F.expr("CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) DIV source_size END"))
    left = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("start")
    return placed.select("doc_id", "src", "key", "size", "alike", "source_size", F.col("target").cast("double").alias("target"), "epochs", left.alias("left"))


#: What the row at ``place`` among those alike takes.
TAKEN = "CAST(epochs * size + greatest(0, least(size, left - place * size)) AS BIGINT)"


def _each(placed: DataFrame) -> DataFrame:
    """A row for each row of the documents, with its ``place`` among those alike; very many of them in several tasks."""
    few, many = placed.where(F.col("alike") <= ALIKE_ROWS), placed.where(F.col("alike") > ALIKE_ROWS)
    parts = many.withColumn("part", F.explode(F.expr(f"sequence(0L, (alike - 1) DIV {ALIKE_ROWS})"))).repartition("key", "part")
    spread = parts.withColumn("place", F.explode(F.expr(f"sequence(part * {ALIKE_ROWS}, least(alike, (part + 1) * {ALIKE_ROWS}) - 1)"))).drop("part")
    return few.withColumn("place", F.explode(F.expr("sequence(0L, alike - 1)"))).unionByName(spread)


def mix(docs: DataFrame, size: Column | None = None, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs``.

    ``size`` defaults to the words of ``text``; a null one is 0. ``taken`` counts whole epochs and, in the last one, all
    documents whose words come before the budget's end; the one document at the cut gives the words up to it. Rows with
    a null source form a source of their own; rows with a null doc_id are documents like any other, and rows with one
    source, id and text are documents of their own that come one after the other. Texts are counted whole, however long.
    An empty table gives an empty result. Other columns are not used.
    """
    scratch = Scratch(docs.sparkSession)
    placed = _placed(scratch, scratch.write(_slim(docs, size, seed), "sizes"))
    source = F.when(F.col("src") != "null", F.substring("src", 2, 2**31 - 1)).alias("source")
    return _each(placed).select("doc_id", source, "size", "source_size", "target", F.expr(TAKEN).alias("taken"))


def mixed(docs: DataFrame, size: Column | None = None, seed: str = "mix") -> DataFrame:
    """The mix itself: a row of ``docs``, with all columns, for each epoch that takes of it.

    ``mix_epoch`` counts from 1; ``mix_words`` are the words that the epoch takes, all of the document's except at the
    cut. Columns of these names in ``docs`` give way. Documents that the mix does not take, and those of no words, go.
    Null ids and sources, repeated rows and empty tables are as in ``mix``; where it takes some of the rows with one
    source, id and text and these differ in further columns, any of them may be the ones.
    """
    docs = docs.drop("mix_epoch", "mix_words")
    scratch = Scratch(docs.sparkSession)
    placed = _placed(scratch, scratch.write(_slim(docs, size, seed), "sizes")).where("epochs > 0 OR left > 0")
    placed = scratch.write(placed.select("src", "key", "size", "alike", "epochs", "left"), "takes")
    keys = ["src", "key"]
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _source().alias("src"), _key(seed).alias("key"))
    alone = row.join(placed.where("alike = 1"), keys).withColumn("place", F.lit(0).cast("long"))
    # rows that are alike are numbered as they stand in a table: by the task that wrote them, then in it
    repeated = placed.where("alike > 1")
    total = repeated.agg(F.coalesce(F.sum("alike"), F.lit(0))).first()[0]
    every = alone
    if total:
        by_key = Salted(repeated.select(*keys, F.col("alike").alias("m")), keys, total)
        held = row.withColumn("task", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id())
        held = scratch.write(by_key.join(held, "number", repeated), "repeated")
        before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        counts = held.groupBy(*keys, "task").agg(F.count("*").alias("n"))
        counts = counts.select(*keys, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        place = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "task").orderBy("number")) - 1
        every = alone.unionByName(held.join(counts, [*keys, "task"]).withColumn("place", place).select(alone.columns))
    taken = every.select("row", "size", F.expr(TAKEN).alias("taken")).where("taken > 0")
    epochs = taken.select("row", "size", "taken", F.explode(F.expr("sequence(1L, (taken + size - 1) DIV size)")).alias("epoch"))
    part = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    return epochs.select("row.*", F.col("epoch").cast("int").alias("mix_epoch"), part.alias("mix_words"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT source, source_size, w, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / w AS full_at FROM s),
-- dealing again until no source is above its cap
deal AS (
  SELECT 0 AS step, source, w, cap, FALSE AS is_full, (SELECT sum(source_size) FROM r) * 1.5::DOUBLE AS total FROM r
  UNION ALL
  SELECT step + 1, source, w, cap,
         is_full OR w * ((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) >= cap, total
  FROM deal WHERE step < 25),
t AS (
  SELECT source, CASE WHEN is_full THEN cap
         ELSE ((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) * w END AS target
  FROM deal WHERE step = 25),
p AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target::DOUBLE AS target,
       ((CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END) * size
        + greatest(0, least(size, floor(target)::BIGINT - (CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END) * source_size - start)))::BIGINT AS taken
FROM p
"""
