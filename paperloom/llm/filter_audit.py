"""Filter interaction audit by direct relational replay.

Every document gets its flags once: which of the filters it fails, whatever the others say. The flags are crossed with all
orders of the filters (120 for five, a broadcast table of fixed size), each document and order is exploded to its steps, the
first failure in the order says where the document goes, and one conditional aggregation, combined in the tasks that made
the rows, counts what each step keeps, removes, and would have removed had nothing gone before.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Salted, Scratch

#: Fixed values of the filters: least words, least share of distinct words and most share of capitals in per cent, junk.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, JUNK = 200, 50, 3, "[#$%&*|]"
FILTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: A is bit 0."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT, capitals * 100 > F.length(text) * MOST_CAPITALS, text.rlike(JUNK))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` for each row of ``docs`` (doc_id, text, lang), as a lazy table.

    ``mask`` has a bit for each filter that the document fails. E, the last, is failed by a text that a row with a
    smaller doc_id has too; rows that repeat a doc_id are not copies of each other, and a null doc_id is neither smaller
    nor greater than any. Null texts are empty, a null lang is the empty part. Of labels that repeat a doc_id the
    greatest counts; documents without labels are neither good nor toxic. Texts are read once and worked on whole; from
    then on a row is a few numbers and a digest. Copies of a text are counted in the tasks that read them, and texts (or
    ids) with many rows are dealt out to several tasks in the joins.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.write(rows, "flags")
    copies = scratch.write(rows.groupBy("digest").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m > 1"), "copies")
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    total = rows.count()
    by_text = Salted(copies.select("digest", "m"), ["digest"], total)
    by_id = Salted(rows.groupBy("doc_id").agg(F.count("*").alias("m")), ["doc_id"], total)
    found = by_id.join(by_text.join(rows, "row", copies.select("digest", "first"), how="left"), "row", judged, how="left")
    copy = F.when(F.col("first") < F.col("doc_id"), 1 << 4).otherwise(0)
    one = lambda label: F.coalesce(F.col(label) == 1, F.lit(False))
    return found.select("part", F.col("mask").bitwiseOR(copy).alias("mask"), one("quality").alias("good"), one("toxic").alias("toxic"))


def replay(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step``, with counts, for all orders of ``filters`` over ``rows`` (part, mask, good, toxic).

    Every part has a row for every order and step, as each of its documents does. ``shapley`` sums what the step's
    filter removes over all orders. An empty table gives an empty result.
    """
    bits = {f: 1 << i for i, f in enumerate(filters)}
    names = ["".join(p) for p in permutations(filters)]
    orders = rows.sparkSession.createDataFrame([(i, [bits[f] for f in name]) for i, name in enumerate(names)], "number int, bits array<int>")
    at = lambda step: F.col("bits")[step - 1]
    fails = lambda bit: F.col("mask").bitwiseAND(bit) != 0
    steps = range(1, len(filters) + 1)
    first = F.coalesce(*[F.when(fails(at(s)), s) for s in steps], F.lit(len(filters) + 1))
    crossed = rows.crossJoin(F.broadcast(orders)).select("part", "mask", "good", "toxic", "number", "bits", first.alias("first"))
    each = crossed.select("part", "mask", "good", "toxic", "number", "first", F.posexplode("bits").alias("place", "bit"))
    gone, failed = F.col("first") == F.col("place") + 1, fails(F.col("bit"))
    counted = each.groupBy("part", "number", "place").agg(
        F.first("bit").alias("bit"),
        F.count_if(F.col("first") > F.col("place") + 1).alias("kept"),
        F.count_if(gone).alias("removed"),
        F.count_if(failed & (F.col("first") <= F.col("place"))).alias("redundant"),
        F.count_if(F.col("mask") == F.col("bit")).alias("unique_fails"),
        F.count_if(gone & F.col("good")).alias("good_lost"),
        F.count_if(gone & F.col("toxic")).alias("toxic_lost"),
    )
    # counts by now: a window holds one row for each order
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    order = F.element_at(F.array(*map(F.lit, names)), F.col("number") + 1)
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return counted.select("part", order.alias("filter_order"), (F.col("place") + 1).alias("step"), *counts, shapley.alias("shapley"))


ORACLE = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
fails AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END AS failed
  FROM texts),
marks AS (
  SELECT f.part, f.failed, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM fails f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
steps AS (
  SELECT part, filter_order, step, failed, good, toxic, substr(filter_order, step, 1) AS letter,
    length(regexp_replace(substr(filter_order, 1, step - 1), '[^' || failed || '_]', '', 'g')) = 0 AS here
  FROM marks, orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
counted AS (
  SELECT part, filter_order, step, any_value(letter) AS letter,
    count(*) FILTER (here AND NOT contains(failed, letter)) AS kept,
    count(*) FILTER (here AND contains(failed, letter)) AS removed,
    count(*) FILTER (NOT here AND contains(failed, letter)) AS redundant,
    count(*) FILTER (failed = letter) AS unique_fails,
    count(*) FILTER (here AND contains(failed, letter) AND good) AS good_lost,
    count(*) FILTER (here AND contains(failed, letter) AND toxic) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
