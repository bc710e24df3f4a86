"""Lists of documents: filters, sort, pages, and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_ignoring_case
from ..functions.rules import SORTS, allowed_classifications, empty, listing_parameters
from .access import Caller, one_of, visible


def filtered(docs: DataFrame, caller: Caller, params: dict, users: DataFrame | None = None) -> DataFrame:
    """Documents that a caller sees and that fit all filters: q, status, classification, year, author."""
    p = listing_parameters(params)
    out = visible(docs, caller)
    if not empty(p.get("q")):
        out = out.where(contains_ignoring_case(F.col("name"), p["q"]))
    if p["status"]:
        out = out.where(one_of(F.col("status"), p["status"]))
    if p["classification"]:
        allowed = p["classification"] if caller.personal else [c for c in p["classification"] if c in allowed_classifications(caller.role)]
        out = out.where(one_of(F.col("classification"), allowed))
    if not empty(p["year"]):
        out = out.where(F.col("year") == p["year"])
    if not empty(p.get("author")):
        authors = users.where(contains_ignoring_case(F.col("full_name"), p["author"])).select(F.col("id").alias("uploaded_by"))
        out = out.join(authors, "uploaded_by", "left_semi")
    return out


def ordering(sort: str = "uploaded_at", direction: str = "desc") -> list[Column]:
    """Nulls count as greatest; equal values go by id, so that pages don't overlap."""
    c = F.col(SORTS[sort])
    return [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first(), F.col("id").asc()]


def page(docs: DataFrame, params: dict) -> DataFrame:
    """One page: Spark keeps only the best ``page * per_page`` rows of each task."""
    p = listing_parameters(params)
    return docs.orderBy(*ordering(p["sort"], p["direction"])).offset((p["page"] - 1) * p["per_page"]).limit(p["per_page"])


#: Names of a listing's fields that are nested in the detail and always empty in the list (fixed values).
NESTED = ("pageFlags", "kpis", "charts", "insights")


def thin(docs: DataFrame) -> DataFrame:
    """The list shape of documents: fields of their own, and nested ones as empty arrays, whatever the documents have."""
    at = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    none = F.array().cast("array<string>")
    return docs.select("id", "name", "type", F.col("size_kb").alias("sizeKb"), "status", "classification", "year", at.alias("uploadedAt"), "pages", *[none.alias(n) for n in NESTED])


def page_meta(docs: DataFrame, params: dict) -> DataFrame:
    per_page = listing_parameters(params)["per_page"]
    return docs.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long").alias("last_page"))


def with_names(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Names of who uploaded and who last changed a document; null where unknown."""
    up = users.select(F.col("id").alias("uploaded_by"), F.col("full_name").alias("uploader"))
    last = users.select(F.col("id").alias("last_updated_by"), F.col("full_name").alias("last_updater"))
    return docs.join(up, "uploaded_by", "left").join(last, "last_updated_by", "left")


def dashboard(docs: DataFrame, caller: Caller) -> DataFrame:
    """One row of counts, of zeros where there are no documents; the total counts unknown states too."""
    count = lambda s: F.count_if(F.col("status") == s)
    return visible(docs, caller).agg(F.count("*").alias("total"), count("Ready").alias("ready"), count("Processing").alias("processing"), count("Needs Review").alias("needs_review"), count("Failed").alias("failed"))
