"""Queries that check model output and turn it into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strict_date
from ..functions.rules import DATE_TYPES, DOCUMENT_TYPES, ENTITY_TYPES, QA_CONFIDENCES, SEVERITIES
from ..operators import fanout
from ..operators import validation as v
from ..sources import table, views
from .registry import query


def decoded(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return views.responses(spark, d, kind).withColumn("j", v.decoded(F.col("raw_json")))


# The oracles work on rows: a row an item, a CASE an item, the first error by min.
_NUMBER = r"'\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*'"


def _decoded_sql(kind: str) -> str:
    return rf"j AS (SELECT id, CASE WHEN json_type(j) IN ('OBJECT', 'ARRAY') THEN j END AS j FROM (SELECT id, TRY_CAST(regexp_replace(trim(raw_json, ' ' || chr(10)), '^```json\s*|\s*```$', '', 'gm') AS JSON) AS j FROM v_{kind}_out))"


def _text(x: str, f: str) -> str:
    return f"(json_type({x}, '$.{f}') IS NOT DISTINCT FROM 'VARCHAR' AND trim({x} ->> '$.{f}', ' ' || chr(9) || chr(10) || chr(13)) <> '')"


def _numeric(x: str, f: str) -> str:
    return f"(CASE WHEN json_type({x}, '$.{f}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') OR json_type({x}, '$.{f}') = 'VARCHAR' AND regexp_full_match({x} ->> '$.{f}', {_NUMBER}) THEN TRY_CAST(trim({x} ->> '$.{f}') AS DOUBLE) END)"


def _word(x: str, f: str, words) -> str:
    return f"(json_type({x}, '$.{f}') IS NOT DISTINCT FROM 'VARCHAR' AND ({x} ->> '$.{f}') IN ({', '.join(repr(w) for w in words)}))"


def _said(message: str, where: str = "''", value: str = "''", **more: str) -> str:
    """A message as an SQL expression; ``where`` and ``value`` are SQL too."""
    text = message.format(where="\0", value="\1", **more).replace("'", "''")
    return "('" + text.replace("\0", f"' || {where} || '").replace("\1", f"' || coalesce({value}, 'null') || '") + "')"


def _shown(n: str) -> str:
    return f"regexp_replace({n}::VARCHAR, '\\.0$', '')"


def _confidence_sql(w: str) -> str:
    n = _numeric("x", "confidence")
    return f"WHEN {n} IS NULL THEN {_said(v.NEEDS_NUMBER, w, field='confidence')} WHEN {n} < 0 OR {n} > 1 THEN {_said(v.OUTSIDE, w + chr(124) * 2 + repr('.confidence'), _shown(n))}"


def _items_sql(field: str) -> str:
    """Items of a list by place, or of an object by name, in the order in which they are written."""
    return f"""n AS (SELECT id, i, CASE WHEN json_type(j, '$.{field}') = 'ARRAY' THEN i::VARCHAR ELSE json_keys(j, '$.{field}')[i + 1] END AS k,
    CASE WHEN json_type(j, '$.{field}') = 'ARRAY' THEN json_extract(j, '$.{field}[' || i || ']') ELSE json_extract(j, '$.{field}."' || json_keys(j, '$.{field}')[i + 1] || '"') END AS x
  FROM j, range(0, 5) r(i) WHERE i < CASE json_type(j, '$.{field}') WHEN 'ARRAY' THEN json_array_length(j, '$.{field}') WHEN 'OBJECT' THEN len(json_keys(j, '$.{field}')) ELSE 0 END)"""


def _list_sql(field: str) -> str:
    w = f"' {field}[' || k || ']'"
    need = lambda f: f"WHEN NOT {_text('x', f)} THEN {_said(v.NEEDS_TEXT, w, field=f)}"
    word = lambda f, words: f"WHEN NOT {_word('x', f, words)} THEN {_said(v.NOT_KNOWN, w + f' || {chr(39)}.{f}{chr(39)}', f'(x ->> {chr(39)}$.{f}{chr(39)})')}"
    date = "try_strptime(x ->> '$.due_date', '%Y-%-m-%-d') IS NOT NULL"
    checks = {
        "entities": [word("entity_type", ENTITY_TYPES), need("value"), _confidence_sql(w)],
        "risks": [need("title"), need("description"), word("severity", SEVERITIES), _confidence_sql(w), need("evidence")],
        "deadlines": [
            need("title"), need("description"), word("date_type", DATE_TYPES),
            f"WHEN x ->> '$.date_type' <> 'explicit' AND json_type(x, '$.due_date') <> 'NULL' THEN {_said(v.HAS_DATE, w, '(x ->> ' + repr('$.date_type') + ')')}",
            f"WHEN x ->> '$.date_type' = 'explicit' AND NOT coalesce(json_type(x, '$.due_date') = 'VARCHAR' AND {date}, false) THEN {_said(v.NO_DATE, w)}",
            _confidence_sql(w), need("evidence"),
        ],
    }[field]
    return f"""
WITH {_decoded_sql(field)}, {_items_sql(field)},
e AS (SELECT id, i, x, CASE WHEN json_type(x) NOT IN ('OBJECT', 'ARRAY') THEN {_said(v.NOT_OBJECT, w)} {' '.join(checks)} END AS error FROM n),
r AS (SELECT j.id, CASE WHEN j IS NULL THEN '{v.NOT_JSON}' WHEN coalesce(json_type(j, '$.{field}'), '') NOT IN ('ARRAY', 'OBJECT') THEN {_said(v.NEEDS_ARRAY, field=field)} ELSE b.error END AS error
      FROM j LEFT JOIN (SELECT id, arg_min(error, i) AS error FROM e WHERE error IS NOT NULL GROUP BY id) b ON b.id = j.id)
"""


_CHECKED = "SELECT id, error IS NULL AS is_valid, error FROM r"


@query("WITH " + _decoded_sql("document_type") + " SELECT id, j IS NOT NULL AS is_valid FROM j")
def json_decode_valid(spark: SparkSession, d: str) -> DataFrame:
    return decoded(spark, d, "document_type").select("id", F.col("j").isNotNull().alias("is_valid"))


@query(_list_sql("entities") + _CHECKED)
def validate_entities(spark: SparkSession, d: str) -> DataFrame:
    return v.checked(v.checked_items(decoded(spark, d, "entities"), "entities"), F.col("error"))


@query(_list_sql("risks") + _CHECKED)
def validate_risks(spark: SparkSession, d: str) -> DataFrame:
    return v.checked(v.checked_items(decoded(spark, d, "risks"), "risks"), F.col("error"))


@query(_list_sql("deadlines") + _CHECKED)
def validate_deadlines(spark: SparkSession, d: str) -> DataFrame:
    return v.checked(v.checked_items(decoded(spark, d, "deadlines"), "deadlines"), F.col("error"))


_N = _numeric("j", "confidence")


_TYPE_SQL = f"""WITH {_decoded_sql("document_type")}, r AS (SELECT id, CASE WHEN j IS NULL THEN '{v.NOT_JSON}' WHEN json_type(j, '$.document_type') IS DISTINCT FROM 'VARCHAR' THEN {_said(v.NEEDS_STRING, field="document_type")}
  WHEN NOT {_word("j", "document_type", DOCUMENT_TYPES)} THEN {_said(v.NOT_KNOWN, "' document_type'", "(j ->> '$.document_type')")}
  WHEN {_N} IS NULL THEN {_said(v.NEEDS_NUMBER, field="confidence")} WHEN {_N} > 1 OR {_N} < 0 THEN {_said(v.OUTSIDE, "' confidence'", _shown(_N))}
  WHEN NOT {_text("j", "reasoning")} THEN {_said(v.NEEDS_TEXT, field="reasoning")} END AS error FROM j)"""


@query(_TYPE_SQL + " " + _CHECKED)
def validate_document_type(spark: SparkSession, d: str) -> DataFrame:
    return v.checked(decoded(spark, d, "document_type"), v.type_error(F.col("j")))


def _summary_sql() -> str:
    """All items of all lists; of a response the first error by list, the list's own before its items'."""
    lists = " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_items_sql(f)} SELECT id, {2 * n + 1} AS place, i, CASE WHEN json_type(x) <> 'VARCHAR' THEN {_said(v.NOT_STRING, f"' {f}[' || k || ']'")} END AS error FROM n
        UNION ALL SELECT id, {2 * n}, 0, CASE WHEN coalesce(json_type(j, '$.{f}'), '') NOT IN ('ARRAY', 'OBJECT') THEN {_said(v.NEEDS_ARRAY, field=f)} END FROM j)"""
        for n, f in enumerate(v.SUMMARY_LISTS)
    )
    return f"""WITH {_decoded_sql('summary')}, e AS ({lists}),
b AS (SELECT id, arg_min(error, 100 * place + i) AS error FROM e WHERE error IS NOT NULL GROUP BY id),
r AS (SELECT j.id, CASE WHEN j IS NULL THEN '{v.NOT_JSON}' WHEN NOT {_text('j', 'executive_summary')} THEN {_said(v.NEEDS_TEXT, field='executive_summary')} ELSE b.error END AS error FROM j LEFT JOIN b ON b.id = j.id)
"""


@query(_summary_sql() + _CHECKED)
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    return v.checked(v.with_items(decoded(spark, d, "summary"), *v.SUMMARY_LISTS), v.summary_error(F.col("j")))


@query(f"""WITH {_decoded_sql("qa")}, {_items_sql("cited_document_ids")},
e AS (SELECT id, i, CASE WHEN json_type(x) <> 'VARCHAR' THEN {_said(v.NOT_STRING, "' cited_document_ids[' || k || ']'")} WHEN (x ->> '$') <> id::VARCHAR THEN {_said(v.NOT_RETRIEVED, value="(x ->> '$')")} END AS error FROM n),
b AS (SELECT id, arg_min(error, i) AS error FROM e WHERE error IS NOT NULL GROUP BY id),
r AS (SELECT j.id, CASE WHEN j IS NULL THEN '{v.NOT_JSON}' WHEN NOT {_text("j", "answer")} THEN {_said(v.NEEDS_TEXT, field="answer")}
  WHEN NOT {_word("j", "confidence", QA_CONFIDENCES)} THEN {_said(v.NOT_KNOWN, "' confidence'", "(j ->> '$.confidence')")}
  WHEN coalesce(json_type(j, '$.cited_document_ids'), '') NOT IN ('ARRAY', 'OBJECT') THEN {_said(v.NEEDS_ARRAY, field="cited_document_ids")}
  WHEN b.error IS NOT NULL THEN b.error WHEN (j ->> '$.confidence') = 'none' AND j.id IN (SELECT id FROM n) THEN {_said(v.NONE_CITES)} END AS error FROM j LEFT JOIN b ON b.id = j.id) {_CHECKED}""")
def validate_qa_citations(spark: SparkSession, d: str) -> DataFrame:
    return v.checked(v.with_items(decoded(spark, d, "qa"), "cited_document_ids"), v.qa_error(F.col("j"), F.array(F.col("id").cast("string"))))


def _wrong_type(field: str, wanted: str, good: str) -> str:
    kind = f"json_type(j, '$.{field}')"
    names = f"CASE {kind} WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'NULL' WHEN 'DOUBLE' THEN 'double' ELSE 'integer' END"
    return f"WHEN {kind} IS NOT NULL AND NOT coalesce({good}, false) THEN {_said(v.WRONG_TYPE, field=field, wanted=wanted, value=names)}"


@query(f"""WITH {_decoded_sql("insights")}, r AS (SELECT id, CASE WHEN j IS NULL THEN '{v.NOT_JSON}' {_wrong_type("kpis", "array", "json_type(j, '$.kpis') IN ('ARRAY', 'OBJECT')")}
  {_wrong_type("charts", "array", "json_type(j, '$.charts') IN ('ARRAY', 'OBJECT')")} {_wrong_type("summary", "string", "json_type(j, '$.summary') = 'VARCHAR'")}
  {_wrong_type("score", "numeric", _numeric("j", "score") + " IS NOT NULL")} END AS error FROM j) {_CHECKED}""")
def validate_insights(spark: SparkSession, d: str) -> DataFrame:
    schema = {"kpis": "array", "charts": "array", "summary": "string", "score": "numeric"}
    return v.checked(decoded(spark, d, "insights"), v.optional_error(F.col("j"), schema))


_ROWS = "SELECT e.id, e.i::INT AS k, {columns} FROM e JOIN r ON r.id = e.id AND r.error IS NULL"


@query(_list_sql("entities") + _ROWS.format(columns=f"x ->> '$.entity_type' AS entity_type, x ->> '$.value' AS value, coalesce(x ->> '$.normalized_value', x ->> '$.value') AS normalized_value, {_numeric('x', 'confidence')}::DECIMAL(4, 3)::DOUBLE AS confidence"))
def entities_rows(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return v.valid_items(decoded(spark, d, "entities"), "entities").select("id", "k", v.string(x["entity_type"]).alias("entity_type"), v.string(x["value"]).alias("value"), F.coalesce(v.string(x["normalized_value"]), v.string(x["value"])).alias("normalized_value"), v.number(x["confidence"]).cast("decimal(4,3)").cast("double").alias("confidence"))


@query(_list_sql("risks") + _ROWS.format(columns=f"x ->> '$.title' AS title, x ->> '$.severity' AS severity, {_numeric('x', 'confidence')}::DECIMAL(4, 3)::DOUBLE AS confidence, 'open' AS status"))
def risks_rows(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return v.valid_items(decoded(spark, d, "risks"), "risks").select("id", "k", v.string(x["title"]).alias("title"), v.string(x["severity"]).alias("severity"), v.number(x["confidence"]).cast("decimal(4,3)").cast("double").alias("confidence"), F.lit("open").alias("status"))


@query(_list_sql("deadlines") + _ROWS.format(columns="x ->> '$.title' AS title, x ->> '$.date_type' AS date_type, try_strptime(x ->> '$.due_date', '%Y-%-m-%-d')::DATE::VARCHAR AS due_date, x ->> '$.relative_text' AS relative_text, 'open' AS status"))
def deadlines_rows(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return v.valid_items(decoded(spark, d, "deadlines"), "deadlines").select("id", "k", v.string(x["title"]).alias("title"), v.string(x["date_type"]).alias("date_type"), strict_date(v.string(x["due_date"])).cast("string").alias("due_date"), v.string(x["relative_text"]).alias("relative_text"), F.lit("open").alias("status"))


def _all_responses(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the responses of all detectors."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("id"), *[F.replace(views.pick(i, *views.RESPONSES[n]), F.lit("<id>"), i.cast("string")).alias(n) for n in fanout.DETECTORS])


def _outcomes_sql(field: str) -> str:
    if field == "document_type":
        return _TYPE_SQL + " SELECT id, error, 1 AS n FROM r"
    return _list_sql(field) + " SELECT r.id, r.error, (SELECT count(*) FROM e WHERE e.id = r.id) AS n FROM r"


@query(
    "SELECT document_type.id, "
    + ", ".join(f"(CASE WHEN {n}.error IS NULL THEN {n}.n END)::INT AS {n}" for n in fanout.DETECTORS)
    + ", array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {n}.error IS NOT NULL THEN '{n}' END" for n in fanout.DETECTORS)
    + "], lambda x: x IS NOT NULL), ',') AS failed FROM "
    + " JOIN ".join(f"({_outcomes_sql(n)}) {n}" + (f" ON {n}.id = document_type.id" if k else "") for k, n in enumerate(fanout.DETECTORS))
)
def intelligence_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Four detectors over one reading; what each found, and which failed, for every document."""
    return fanout.FanOut(_all_responses(spark, d)).summary()
