"""Vector search: exact cosine top-k within what the caller may see, then a floor, then context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cosine
from ..functions.json_text import pretty
from ..functions.rules import FLOOR
from .access import Caller, of_tenant, one_of, visible


def vector_of(embeddings: DataFrame, id_: int) -> list[float] | None:
    """The embedding of one row, looked up by id."""
    row = embeddings.where(F.col("id") == id_).select("embedding").first()
    return None if row is None else row[0]


def similarity(query: list[float]) -> Column:
    """Similarity to a query vector; its norm is worked out once, on the driver. Null for null and zero vectors."""
    return cosine(F.col("embedding"), F.lit([float(x) for x in query]))


def top_k(embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k most similar rows: each task keeps its own k best, so no shuffle of vectors. Null similarities come last."""
    return embeddings.withColumn("similarity", similarity(query)).drop("embedding").orderBy(F.col("similarity").desc_nulls_last(), "id").limit(k)


def search(embeddings: DataFrame, docs: DataFrame, caller: Caller, query: list[float], k: int = 10, floor: float = FLOOR) -> DataFrame:
    """The k best chunks that the caller may see, and of them those at the floor or above.

    Chunks are ranked without their texts; texts and names are read for the best alone.
    """
    chunks = of_tenant(embeddings, caller.workspace_id, null_safe=False).select("id", "document_id", "embedding")
    seen = visible(docs, caller, search=True).select(F.col("id").alias("document_id"))
    best = local(top_k(chunks.join(seen, "document_id"), query, k))
    ids, owners = ([r[c] for r in best.collect()] for c in ("id", "document_id"))
    # the owners' ids reach the scan of documents through the join
    texts = embeddings.where(one_of(F.col("id"), ids) & one_of(F.col("document_id"), owners)).select("id", "chunk_index", F.col("chunk_text").alias("excerpt"))
    names = docs.where(one_of(F.col("id"), owners)).select(F.col("id").alias("document_id"), "name", "classification")
    found = best.where(F.col("similarity") >= floor).join(texts, "id").join(names, "document_id")
    return found.select("id", "document_id", "name", "classification", "chunk_index", "excerpt", F.round("similarity", 4).alias("similarity"))


def local(best: DataFrame) -> DataFrame:
    """The rows of a top-k list as a local table, so that what is joined to it doesn't search again."""
    return best.sparkSession.createDataFrame(best.toArrow(), best.schema)


def gathered(rows: DataFrame, key: str, order: str, fields: list[Column], name: str) -> DataFrame:
    """Children of each parent as one ordered array, made before any join so that children don't multiply."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_v")))).alias("_l")).select(key, F.transform("_l", lambda x: x["_v"]).alias(name))


def context(hits: DataFrame, docs: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """One row a document of the hits (a top-k list): its excerpts and its children (``document_id``, ``id``, ...) as JSON."""
    ids = sorted({r.document_id for r in hits.select("document_id").collect()})
    found = gathered(hits, "document_id", "rank", [F.col("excerpt").alias("text"), F.col("similarity").alias("score")], "excerpts")
    out = docs.where(one_of(F.col("id"), ids)).select(F.col("id").alias("document_id"), "name", "classification").join(found, "document_id")
    for name, rows in children.items():
        part = rows.where(one_of(F.col("document_id"), ids))
        listed = gathered(part, "document_id", "id", [F.col(c) for c in rows.columns if c not in ("id", "document_id")], name)
        out = out.join(listed, "document_id", "left")
    return out


def prompt_context(found: DataFrame, hits: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row, ``context``: what a prompt gets of ``context`` and its hits, as an indented JSON text.

    Documents stand in order of their best hit, their children (``names``) in the same order and by id, excerpts by rank.
    Without hits all lists are empty.
    """
    ranks = hits.groupBy("document_id").agg(F.min("rank").alias("_rank"))
    own = F.struct(F.col("document_id").alias("id"), "name", "classification")

    def child(name: str) -> Column:
        fields = found.schema[name].dataType.elementType.names
        listed = F.transform(F.coalesce(name, F.array().cast(found.schema[name].dataType)), lambda x: F.struct(F.col("document_id"), *[x[f].alias(f) for f in fields]))
        return listed.alias(name)

    rows = found.join(ranks, "document_id").select("_rank", own.alias("documents"), *[child(n) for n in names])
    # a top-k list's documents: a few rows
    listed = F.sort_array(F.collect_list(F.struct("_rank", "documents", *names)))
    one = rows.agg(listed.alias("l")).select(F.col("l")["documents"].alias("documents"), *[F.flatten(F.col("l")[n]).alias(n) for n in names])
    chunk = F.struct("rank", F.struct("document_id", F.col("excerpt").alias("text"), F.col("similarity").alias("score")).alias("x"))
    chunks = hits.agg(F.sort_array(F.collect_list(chunk)).alias("c")).select(F.transform("c", lambda x: x["x"]).alias("relevant_excerpts"))
    both = one.join(F.broadcast(chunks)).select(F.struct("documents", *names, "relevant_excerpts").alias("v"))
    return both.select(pretty(F.col("v"), both.schema["v"].dataType).alias("context"))
