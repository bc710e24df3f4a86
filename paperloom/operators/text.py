"""Text of documents: paragraphs, chunks, recognised pages, routing, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_blank, trimmed
from ..functions.rules import CHUNK_CHARS, CHUNKS

PARAGRAPH = r"\n\s*\n"
#: Placeholders of prompts (fixed pattern).
PLACEHOLDER = r"\{\{(\w+)\}\}"


def paragraphs(text: Column, separator: str = PARAGRAPH) -> Column:
    """Non-blank trimmed paragraphs in order; an empty array for a null text."""
    parts = F.transform(F.split(trimmed(F.coalesce(text, F.lit(""))), separator), trimmed)
    return F.filter(parts, lambda x: x != "")


def packed(parts: Column, size: int = CHUNK_CHARS, most: int = CHUNKS) -> Column:
    """Paragraphs packed greedily into chunks.

    A chunk closes when the next paragraph would take it above ``size`` characters, blank lines between not counted. A
    longer paragraph is a chunk of its own. After ``most`` chunks the rest is left out.
    """
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        first, full = s["now"] == "", (F.length(s["now"]) + F.length(p) > size) & (s["now"] != "")
        over = F.size(s["done"]) >= most
        now = F.when(over, s["now"]).when(first | full, p).otherwise(F.concat(s["now"], F.lit("\n\n"), p))
        return F.struct(now.alias("now"), F.when(full & ~over, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"))

    end = lambda s: F.slice(F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]), 1, most)
    return F.aggregate(parts, start, step, end)


def chunks(docs: DataFrame, separator: str = PARAGRAPH, size: int = CHUNK_CHARS, most: int = CHUNKS) -> DataFrame:
    """``document_id, chunk_index`` (from 0) and ``chunk_text`` of all ``docs`` (id, extracted_text)."""
    return docs.select(F.col("id").alias("document_id"), F.posexplode(packed(paragraphs(F.col("extracted_text"), separator), size, most)).alias("chunk_index", "chunk_text"))


def words_of_tsv(tsv: Column) -> Column:
    """Words (position, word, conf) of a recogniser's table: rows of 12 cells, a confidence of 0 or above, not blank."""
    lines = F.filter(F.split(tsv, "\n"), lambda _, i: i > 0)
    cells = F.transform(lines, lambda line, i: F.struct(i.alias("position"), F.split(line, "\t").alias("c")))
    whole = F.filter(cells, lambda x: F.size(x["c"]) >= 12)
    words = F.transform(whole, lambda x: F.struct(x["position"].alias("position"), x["c"][11].alias("word"), x["c"][10].try_cast("double").alias("conf")))
    return F.filter(words, lambda x: (x["conf"] >= 0) & ~is_blank(x["word"]))


def page_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: x["word"]), " ")


def page_confidence(words: Column) -> Column:
    """Mean confidence as a share with two digits; 0 for a page without words."""
    total = F.aggregate(words, F.lit(0.0), lambda s, x: s + x["conf"])
    return F.round(F.coalesce(F.try_divide(total, F.size(words) * F.lit(100.0)), F.lit(0.0)), 2)


def joined_pages(pages: DataFrame) -> DataFrame:
    """``document_id, text, pages``: page texts in page order, with a form feed between."""
    listed = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return listed.select("document_id", F.array_join(F.transform("p", lambda x: x["text"]), "\f").alias("text"), F.size("p").cast("long").alias("pages"))


#: Messages of documents without text (fixed values).
NO_TEXT, OCR_OFF, NO_OCR_TEXT = "No extractable text found in this document.", "No extractable text found and OCR is disabled for this workspace.", "OCR ran but found no readable text — needs manual review."


def routed(text: Column, type_: Column, ocr_enabled: Column, ocr_text: Column) -> Column:
    """Where a document goes after extraction: (route, status, error)."""
    can, on = type_.isin("PDF", "JPG", "PNG"), F.coalesce(ocr_enabled, F.lit(False))
    said = lambda route, status, error: F.struct(F.lit(route).alias("route"), F.lit(status).cast("string").alias("status"), F.lit(error).cast("string").alias("error"))
    return (
        F.when(~is_blank(text), said("native", None, None))
        .when(~can, said("none", "Failed", NO_TEXT))
        .when(~on, said("none", "Failed", OCR_OFF))
        .when(is_blank(ocr_text), said("ocr", "Needs Review", NO_OCR_TEXT))
        .otherwise(said("ocr", None, None))
    )


def provider(preferred: Column, default: str, supports: dict[str, Column]) -> Column:
    """The first provider that supports a document: the preferred one if known, the default, then the others in order."""
    known = F.coalesce(preferred, F.lit(""))
    chosen = [F.when((known == k) & can, F.lit(k)) for k, can in supports.items()]
    return F.coalesce(*chosen, *[F.when(supports[k], F.lit(k)) for k in [default, *(x for x in supports if x != default)]])


def rendered(template: str, values: dict[str, Column]) -> Column:
    """(text, error) of a prompt. Placeholders are replaced in one pass, so values are not searched for placeholders to fill.

    A placeholder without a value is an error, and so is one that is left in the result, even if a value brought it.
    """
    parts = re.split(PLACEHOLDER, template)
    missing = [p for p in parts[1::2] if p not in values]
    if missing:
        return F.struct(F.lit(None).cast("string").alias("text"), F.lit(f"missing required variable: {missing[0]}").alias("error"))
    text = F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    left = text.rlike(r"\{\{\w+\}\}")
    return F.struct(F.when(~left, text).alias("text"), F.when(left, F.lit("unresolved placeholder")).alias("error"))


def piped(rows: DataFrame, sheet: str, order: str, cells: list[str]) -> DataFrame:
    """Each sheet as text: a title line, then its rows in order with bars between cells; null cells are empty."""
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])
    listed = rows.groupBy(sheet).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"))
    title = F.concat(F.lit("=== Sheet: "), F.col(sheet).cast("string"), F.lit(" ==="))
    return listed.select(sheet, F.array_join(F.concat(F.array(title), F.transform("l", lambda x: x["line"])), "\n").alias("text"))


def extraction(text: Column, type_: Column) -> Column:
    """Text by file type: images have none, other types than the known are an error of their row."""
    known = type_.isin("PDF", "DOCX", "XLSX")
    return F.struct(F.when(known, text).when(type_.isin("JPG", "PNG"), F.lit("")).alias("text"), F.when(~known & ~type_.isin("JPG", "PNG"), F.concat(F.lit("Unsupported type: "), type_)).alias("error"))
