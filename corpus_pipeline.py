"""The corpus pipeline: documents in, a clean training mix out.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and rereads for the next. All stages but the last return the columns of ``documents``; rows
keep their further columns throughout. Null and empty texts, repeated rows and empty tables pass every stage:

Texts are worked on whole, however long.

* toxicity: documents whose text is judged toxic go; null and empty texts stay.
* near duplicates: of each component the document with the smallest id stays, of rows that repeat its id the one with
  words whose text and further columns hash least. Documents without words, and those with a null id, are nobody's
  duplicates and stay.
* decontamination: documents that hold a benchmark item go.
* personal data: no row goes; spans in the text give way to their kind in brackets.
* mixing: every document once for each epoch that takes of it, with the words taken; what the mix does not take goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bm25, mixing, neardup, pii, toxicity
from paperloom.llm.shared import WORD, Salted, Scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. The chain learns from the labelled rows of ``docs``."""
    return toxicity.clean(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, on shingles of five words at a similarity of 0.8."""
    found = neardup.near_duplicates(docs).where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a row for each id that has words: how often, and whether it goes; other rows stay without a look at them
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(~F.col("kept")).alias("gone"))
    told = written(ids.where("gone OR n > 1"), "told")
    key = F.when(F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)), F.col("doc_id").cast("long"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("doc_id"), F.monotonically_increasing_id().alias("place"))
    # rows without a key need no join; an id that many rows repeat is dealt out by their places
    repeated = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_id = Salted(told.select("doc_id", F.col("n").alias("m")), ["doc_id"], repeated)
    joined = by_id.join(rows.where("doc_id IS NOT NULL"), "place", told, how="left").where("NOT coalesce(gone, false)")
    alone = rows.where("doc_id IS NULL").withColumns({"n": F.lit(1).cast("long"), "gone": F.lit(False)})
    kept = joined.select("row", "doc_id", "n").unionByName(alone.select("row", "doc_id", "n"))
    # only rows that repeat an id are compared with each other
    first = F.min_by("row", F.struct(F.xxhash64("row.text"), F.xxhash64("row"))).alias("row")
    once = kept.where("n > 1").groupBy("doc_id").agg(first)
    return kept.where("coalesce(n, 1) = 1").select("row.*").unionByName(once.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, against all items of ``benchmark``."""
    return bm25.clean(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, by the weights of its query."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("mixing", mix),
]

#: Learned models, MinHash and weak supervision are beyond SQL; tests hold each stage's rows against a plain version:
#: scores by their definition, all pairs, all pieces of all items, patterns, and a walk over each source.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted when the next one is written."""
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(before)
    return docs
