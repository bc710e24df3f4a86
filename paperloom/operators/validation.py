"""Strict checks of model output. A bad response never fails the job: it gets an error, the first in the order of checks.

A response is decoded once to ``j`` (``raw``, its JSON text, and ``v``, its variant). A list may also be an object, whose
values count as items in the order in which they are written, by their names. Items become structs of the fields that
checks and rows need, so each field is taken out of the JSON once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_blank, is_number, strict_date, trimmed
from ..functions.rules import DATE_TYPES, DOCUMENT_TYPES, ENTITY_TYPES, QA_CONFIDENCES, SEVERITIES

#: Messages (fixed values).
NOT_JSON = "AI response is not valid JSON"
NEEDS_ARRAY = "AI response missing required array field: {field}"
NEEDS_TEXT = "AI response{where} missing required non-empty string field: {field}"
NEEDS_STRING = "AI response missing required string field: {field}"
NEEDS_NUMBER = "AI response{where} missing required numeric field: {field}"
NOT_OBJECT = "AI response{where} is not an object."
NOT_STRING = "AI response{where} is not a string."
NOT_KNOWN = "AI response{where} '{value}' is not in the controlled vocabulary."
OUTSIDE = "AI response{where} {value} is outside the valid range 0.0-1.0."
WRONG_TYPE = "AI response field '{field}' expected type '{wanted}', got '{value}'"
HAS_DATE = "AI response{where} has a due_date but date_type is '{value}' — only 'explicit' deadlines may have a due_date."
NO_DATE = "AI response{where} has date_type 'explicit' but due_date is missing or not a valid YYYY-MM-DD date."
NOT_RETRIEVED = "AI response cited document ID '{value}' was not present in the retrieved context — hallucinated citation rejected."
NONE_CITES = "AI response confidence is 'none' but cited_document_ids is non-empty — a no-answer response must not cite documents."
#: Names of types in messages (fixed values).
TYPES = {"ARRAY": "array", "OBJECT": "array", "STRING": "string", "BIGINT": "integer", "DECIMAL": "double", "DOUBLE": "double", "BOOLEAN": "boolean", "VOID": "NULL"}


def decoded(raw: Column) -> Column:
    """The JSON object or array of a response, fences around it taken off, as ``raw`` and ``v``; null for anything else."""
    text = F.regexp_replace(trimmed(raw), r"(?m)^```json\s*|\s*```$", "")
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.struct(text.alias("raw"), v.alias("v")))


def field(v: Column, name: str | None = None) -> Column:
    """``kind`` (OBJECT, ARRAY, STRING, BIGINT, ...; null where there is none, VOID for JSON's null) and ``text`` of a field, or of ``v``."""
    x = v if name is None else F.try_variant_get(v, f"$.{name}", "variant")
    return F.struct(F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0).alias("kind"), F.try_variant_get(x, "$", "string").alias("text"))


def is_text(f: Column) -> Column:
    return F.coalesce(f["kind"] == "STRING", F.lit(False))


def string(f: Column) -> Column:
    return F.when(is_text(f), f["text"])


def number(f: Column) -> Column:
    """Numbers, and texts that are numbers."""
    plain = f["kind"].isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT")
    return F.when(plain | (is_text(f) & is_number(f["text"])), trimmed(f["text"]).try_cast("double"))


def items(j: Column, name: str, fields: tuple[str, ...] | None) -> Column:
    """Items of a list or object: ``k`` (place or name), ``kind``, and each of ``fields``, or ``text`` where there are none."""
    path = f"$.{name}"
    kind = field(j["v"], name)["kind"]

    def item(k: Column, x: Column) -> Column:
        own = field(x)
        return F.struct(k.alias("k"), own["kind"].alias("kind"), *([field(x, f).alias(f) for f in fields] if fields else [own["text"].alias("text")]))

    listed = F.transform(F.try_variant_get(j["v"], path, "array<variant>"), lambda x, i: item(i.cast("string"), x))
    # a variant's names are sorted, those of the text are as written
    values = F.try_variant_get(j["v"], path, "map<string,variant>")
    named = F.transform(F.json_object_keys(F.get_json_object(j["raw"], path)), lambda k: item(k, F.element_at(values, k)))
    return F.when(kind == "ARRAY", listed).when(kind == "OBJECT", named)


def shown(n: Column) -> Column:
    """A number as messages show it: without a fraction that is zero."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def said(message: str, where: Column | str = "", value: Column | None = None, **more: str) -> Column:
    """A message with its parts filled in; ``where`` follows a blank."""
    out = F.lit(message.format(where="\0", value="\1", **more))
    at = F.lit(where) if isinstance(where, str) else F.concat(F.lit(" "), where)
    return F.replace(F.replace(out, F.lit("\0"), at), F.lit("\1"), F.coalesce(value, F.lit("null")) if value is not None else F.lit(""))


def first(*checks: tuple[Column, Column]) -> Column:
    """The message of the first check that is true."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in checks])


def _blank(x: Column, where: Column, name: str) -> tuple[Column, Column]:
    return is_blank(string(x[name])), said(NEEDS_TEXT, where, field=name)


def _vocabulary(x: Column, where: Column, name: str, words) -> tuple[Column, Column]:
    return ~F.coalesce(string(x[name]).isin(*words), F.lit(False)), said(NOT_KNOWN, F.concat(where, F.lit(f".{name}")), x[name]["text"])


def _confidence(x: Column, where: Column) -> list[tuple[Column, Column]]:
    n = number(x["confidence"])
    return [(n.isNull(), said(NEEDS_NUMBER, where, field="confidence")), ((n < 0) | (n > 1), said(OUTSIDE, F.concat(where, F.lit(".confidence")), shown(n)))]


def _entity(x: Column, where: Column) -> list:
    return [_vocabulary(x, where, "entity_type", ENTITY_TYPES), _blank(x, where, "value"), *_confidence(x, where)]


def _risk(x: Column, where: Column) -> list:
    return [_blank(x, where, "title"), _blank(x, where, "description"), _vocabulary(x, where, "severity", SEVERITIES), *_confidence(x, where), _blank(x, where, "evidence")]


def _deadline(x: Column, where: Column) -> list:
    type_, due = string(x["date_type"]), string(x["due_date"])
    given = F.coalesce(x["due_date"]["kind"] != "VOID", F.lit(False))
    return [
        _blank(x, where, "title"), _blank(x, where, "description"), _vocabulary(x, where, "date_type", DATE_TYPES),
        ((type_ != "explicit") & given, said(HAS_DATE, where, type_)), ((type_ == "explicit") & strict_date(due).isNull(), said(NO_DATE, where)),
        *_confidence(x, where), _blank(x, where, "evidence"),
    ]


CHECKS = {"entities": _entity, "risks": _risk, "deadlines": _deadline}
#: Fields of an item.
FIELDS = {
    "entities": ("entity_type", "value", "normalized_value", "confidence"),
    "risks": ("title", "description", "severity", "confidence", "evidence"),
    "deadlines": ("title", "description", "date_type", "due_date", "relative_text", "confidence", "evidence"),
}


def _place(name: str, x: Column) -> Column:
    return F.concat(F.lit(f"{name}["), x["k"], F.lit("]"))


def _first_of(listed: Column, error) -> Column:
    return F.get(F.filter(F.transform(listed, error), lambda e: e.isNotNull()), F.lit(0))


def list_error(j: Column, listed: Column, name: str) -> Column:
    """The first error of a response that lists entities, risks or deadlines (``listed``, its items); one bad item rejects all of it."""

    def of_item(x: Column) -> Column:
        where = _place(name, x)
        return first((~F.coalesce(x["kind"].isin("OBJECT", "ARRAY"), F.lit(False)), said(NOT_OBJECT, where)), *CHECKS[name](x, where))

    return F.coalesce(first((j.isNull(), F.lit(NOT_JSON)), (listed.isNull(), said(NEEDS_ARRAY, field=name))), _first_of(listed, of_item))


def type_error(j: Column) -> Column:
    f = {name: field(j["v"], name) for name in ("document_type", "confidence", "reasoning")}
    word, n = string(f["document_type"]), number(f["confidence"])
    return first(
        (j.isNull(), F.lit(NOT_JSON)), (word.isNull(), said(NEEDS_STRING, field="document_type")), (~word.isin(*DOCUMENT_TYPES), said(NOT_KNOWN, F.lit("document_type"), word)),
        (n.isNull(), said(NEEDS_NUMBER, field="confidence")), ((n < 0) | (n > 1), said(OUTSIDE, F.lit("confidence"), shown(n))), (is_blank(string(f["reasoning"])), said(NEEDS_TEXT, field="reasoning")),
    )


SUMMARY_LISTS = ("key_findings", "critical_risks", "upcoming_deadlines", "important_entities", "recommended_attention")


def _not_string(name: str):
    return lambda x: F.when(~is_text(x), said(NOT_STRING, _place(name, x)))


def with_items(responses: DataFrame, *names: str) -> DataFrame:
    """``responses`` with the items of lists of texts as columns, each made once."""
    return responses.withColumns({name: items(F.col("j"), name, None) for name in names})


def summary_error(j: Column) -> Column:
    """The first error of a summary; its lists are columns (``with_items``)."""
    out = [first((j.isNull(), F.lit(NOT_JSON)), (is_blank(string(field(j["v"], "executive_summary"))), said(NEEDS_TEXT, field="executive_summary")))]
    for name in SUMMARY_LISTS:
        listed = F.col(name)
        out += [first((listed.isNull(), said(NEEDS_ARRAY, field=name))), _first_of(listed, _not_string(name))]
    return F.coalesce(*out)


def qa_error(j: Column, available: Column) -> Column:
    """Answers cite only what was retrieved, and an answer of no confidence cites nothing. Citations are a column (``with_items``)."""
    cited, word = F.col("cited_document_ids"), field(j["v"], "confidence")

    def of_id(x: Column) -> Column:
        return first((~is_text(x), said(NOT_STRING, _place("cited_document_ids", x))), (~F.array_contains(available, x["text"]), said(NOT_RETRIEVED, value=x["text"])))

    return F.coalesce(
        first((j.isNull(), F.lit(NOT_JSON)), (is_blank(string(field(j["v"], "answer"))), said(NEEDS_TEXT, field="answer")), (~F.coalesce(string(word).isin(*QA_CONFIDENCES), F.lit(False)), said(NOT_KNOWN, F.lit("confidence"), word["text"])), (cited.isNull(), said(NEEDS_ARRAY, field="cited_document_ids"))),
        _first_of(cited, of_id),
        first(((string(word) == "none") & (F.size(cited) > 0), F.lit(NONE_CITES))),
    )


def optional_error(j: Column, schema: dict[str, str]) -> Column:
    """Fields that are there must have their type (array, string, numeric); JSON's null is a wrong type."""
    out = [F.when(j.isNull(), F.lit(NOT_JSON))]
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    for name, wanted in schema.items():
        f = field(j["v"], name)
        good = {"array": f["kind"].isin("ARRAY", "OBJECT"), "string": is_text(f), "numeric": number(f).isNotNull()}[wanted]
        there = F.coalesce(f["kind"], F.lit("")) != ""
        out.append(F.when(there & ~F.coalesce(good, F.lit(False)), said(WRONG_TYPE, field=name, wanted=wanted, value=F.element_at(names, f["kind"]))))
    return F.coalesce(*out)


def checked(responses: DataFrame, error: Column) -> DataFrame:
    """``id, is_valid, error`` for each response."""
    return responses.withColumn("error", error).select("id", F.col("error").isNull().alias("is_valid"), "error")


def checked_items(responses: DataFrame, name: str) -> DataFrame:
    """``responses`` with their ``items`` of entities, risks or deadlines and the first ``error``."""
    listed = responses.withColumn("items", items(F.col("j"), name, FIELDS[name]))
    return listed.withColumn("error", list_error(F.col("j"), F.col("items"), name))


def valid_items(responses: DataFrame, name: str) -> DataFrame:
    """``id, k`` (from 0) and ``x``, the fields, for each item of the valid responses.

    A filter on the error, or one that an inner explode implies, would be pushed below and work all of it out again.
    """
    good = checked_items(responses, name).select("id", F.when(F.col("error").isNull(), F.col("items")).alias("items"))
    return good.select("id", F.posexplode_outer("items").alias("k", "x")).where("k IS NOT NULL")
