"""Queries of vector search and of the context that it gathers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import FLOOR
from ..operators import ivf, vectors
from ..operators.access import Caller
from ..sources import table, views
from .access import ADMIN
from .registry import query
from .reporting import findings


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_SIMILAR = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {q}))"


def _search_sql(q: int, tenant: str, rule: str, floor: float, k: int = 10) -> str:
    best = f"""
SELECT e.id, e.document_id, d.name, d.classification, e.chunk_index, e.chunk_text AS excerpt, {_SIMILAR.format(q=q)} AS s
FROM v_embeddings e JOIN v_documents d ON d.id = e.document_id WHERE e.workspace_id = '{tenant}' AND {rule} ORDER BY s DESC NULLS LAST, e.id LIMIT {k}"""
    return f"SELECT id, document_id, name, classification, chunk_index, excerpt, round(s, 4) AS similarity FROM ({best}) WHERE s >= {floor}"


def _search(spark: SparkSession, d: str, caller: Caller, q: int, floor: float, k: int = 10) -> DataFrame:
    wanted = vectors.vector_of(_vectors(spark, d), q)
    return vectors.search(views.embeddings(spark, d), views.documents(spark, d, status=False), caller, wanted, k, floor)


@query(_search_sql(12, "src3", "true", FLOOR))
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """An administrator's search: ten best of the workspace, then the floor."""
    return _search(spark, d, ADMIN, 12, FLOOR)


@query(_search_sql(12, "src3", "true", 0.0))
def vector_search_floor0(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, ADMIN, 12, 0.0)


@query(_search_sql(12, "src10", "d.uploaded_by = 3", -1.0))
def vector_search_personal(spark: SparkSession, d: str) -> DataFrame:
    """In a personal workspace only one's own documents are searched."""
    return _search(spark, d, Caller(3, "Viewer", "src10", personal=True), 12, -1.0)


@query(f"SELECT vec_id AS id, round({_SIMILAR.format(q=0)}, 4) AS similarity FROM embeddings e")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return rows.select("id", F.round(vectors.similarity(vectors.vector_of(rows, 0)), 4).alias("similarity"))


@query(f"SELECT vec_id AS id, round({_SIMILAR.format(q=0)}, 4) AS similarity FROM embeddings e ORDER BY {_SIMILAR.format(q=0)} DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return vectors.top_k(rows, vectors.vector_of(rows, 0), 10).select("id", F.round("similarity", 4).alias("similarity"))


@query(f"SELECT * FROM (SELECT vec_id AS id, round({_SIMILAR.format(q=0)}, 4) AS similarity FROM embeddings e ORDER BY {_SIMILAR.format(q=0)} DESC, vec_id LIMIT 10) WHERE similarity >= {FLOOR}")
def vector_search_unscoped(spark: SparkSession, d: str) -> DataFrame:
    return vector_topk(spark, d).where(F.col("similarity") >= FLOOR)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks with their rank; five rows, so the window needs no key."""
    return vectors.local(_search(spark, d, ADMIN, 12, -1.0, 5)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))


_HITS = f"WITH h AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM ({_search_sql(12, 'src3', 'true', -1.0, 5)}))"


@query(_HITS + " SELECT document_id, min(rank)::INT AS rank FROM h GROUP BY document_id")
def context_distinct_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the hits, in order of their best."""
    return _hits(spark, d).groupBy("document_id").agg(F.min("rank").alias("rank"))


@query(_HITS + """, x AS (SELECT document_id, string_agg(score::VARCHAR, ',' ORDER BY rank) AS s FROM (SELECT document_id, rank, similarity AS score FROM h) GROUP BY document_id)
SELECT x.document_id, d.name, d.classification, x.s AS scores,
  coalesce((SELECT string_agg(value, ',' ORDER BY id) FROM v_entities e WHERE e.document_id = x.document_id), '') AS entities,
  coalesce((SELECT string_agg(value, ',' ORDER BY id) FROM v_risks e WHERE e.document_id = x.document_id), '') AS risks,
  coalesce((SELECT string_agg(value, ',' ORDER BY id) FROM v_deadlines e WHERE e.document_id = x.document_id), '') AS deadlines
FROM x JOIN v_documents d ON d.id = x.document_id""")
def qa_context(spark: SparkSession, d: str) -> DataFrame:
    """What a question is answered from, shown flat: documents of the hits with their excerpts' scores and findings."""
    found = vectors.context(_hits(spark, d), views.documents(spark, d, status=False), findings(spark, d))
    values = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["value"]), ","), F.lit("")).alias(c)
    scores = F.array_join(F.transform("excerpts", lambda x: x["score"].cast("string")), ",")
    return found.select("document_id", "name", "classification", scores.alias("scores"), *[values(c) for c in views.EVERY])


@query("""
SELECT query_id, rank::INT AS rank, id, round(s, 4) AS similarity FROM (
  SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
    FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0))
WHERE rank <= 10""")
def vector_topk_ivf(spark: SparkSession, d: str) -> DataFrame:
    """Ten best of every fiftieth vector by the index of cells, made exact by the cells' radii."""
    rows = _vectors(spark, d)
    found = ivf.top_k(ivf.build(rows), rows.where("id % 50 = 0"), 10, exact=True)
    return found.select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity"))


def _quoted_sql(text: str) -> str:
    """A text as an ASCII JSON string; characters beyond the first 65,536 don't occur in the tables."""
    cases = " ".join(f"WHEN ch = {c} THEN '{to}'" for c, to in (("'\"'", '\\"'), ("'\\'", "\\\\"), ("'/'", "\\/"), ("chr(8)", "\\b"), ("chr(12)", "\\f"), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")))
    shown = f"CASE WHEN ch = '' THEN '' {cases} WHEN unicode(ch) < 32 OR unicode(ch) > 127 THEN '\\u' || lpad(lower(hex(unicode(ch))), 4, '0') ELSE ch END"
    return f"""CASE WHEN {text} IS NULL THEN 'null' ELSE '"' || array_to_string(list_transform(string_split({text}, ''), lambda ch: {shown}), '') || '"' END"""


def _list_of_sql(name: str, fields: dict[str, str], source: str, order: str) -> str:
    lines = " || ',' || chr(10) || ".join(f"""'            "{f}": ' || {value}""" for f, value in fields.items())
    item = f"'        {{' || chr(10) || {lines} || chr(10) || '        }}'"
    return f"""'    "{name}": ' || (SELECT CASE WHEN count(*) = 0 THEN '[]' ELSE '[' || chr(10) || string_agg({item}, ',' || chr(10) ORDER BY {order}) || chr(10) || '    ]' END FROM {source})"""


_LISTS = [
    _list_of_sql("documents", {"id": "x.document_id", "name": _quoted_sql("d.name"), "classification": _quoted_sql("d.classification")}, "x JOIN v_documents d ON d.id = x.document_id", "x.rank"),
    *(_list_of_sql(n, {"document_id": "e.document_id", "value": _quoted_sql("e.value"), "percent": "e.percent"}, f"v_{n} e JOIN x ON x.document_id = e.document_id", "x.rank, e.id") for n in views.EVERY),
    _list_of_sql("relevant_excerpts", {"document_id": "h.document_id", "text": _quoted_sql("h.excerpt"), "score": "regexp_replace(h.similarity::VARCHAR, '\\.0$', '')"}, "h", "h.rank"),
]


@query(_HITS + ", x AS (SELECT document_id, min(rank) AS rank FROM h GROUP BY document_id) SELECT '{' || chr(10) || " + " || ',' || chr(10) || ".join(_LISTS) + " || chr(10) || '}' AS context")
def qa_context_json(spark: SparkSession, d: str) -> DataFrame:
    """The context as the prompt gets it: one indented JSON text of documents, findings and excerpts."""
    hits = _hits(spark, d)
    found = vectors.context(hits, views.documents(spark, d, status=False), findings(spark, d))
    return vectors.prompt_context(found, hits, tuple(views.EVERY))
