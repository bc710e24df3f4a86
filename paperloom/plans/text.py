"""Queries of text: paragraphs, chunks, recognised pages, routing, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_blank
from ..functions.rules import CHUNK_CHARS, CHUNKS, TEXT_CHARS
from ..operators import text
from ..sources import table, views
from .registry import query


def _chunks_sql(source: str, separator: str) -> str:
    return f"""
WITH p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(11)), '{separator}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11))), lambda x: x <> '') AS p FROM ({source})),
c AS (SELECT id, list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN length(a[len(a)]) + length(b[1]) > {CHUNK_CHARS} THEN list_concat(a, b)
        ELSE list_concat(a[1:len(a) - 1], [a[len(a)] || chr(10) || chr(10) || b[1]]) END)[1:{CHUNKS}] AS c FROM p WHERE len(p) > 0)
SELECT id AS document_id, (i - 1)::INT AS chunk_index, c[i] AS chunk_text FROM c, range(1, {CHUNKS + 1}) r(i) WHERE i <= len(c)"""


@query(_chunks_sql("SELECT id, extracted_text AS t FROM v_documents", "\\n\\s*\\n"))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return text.chunks(views.documents(spark, d, status=False))


@query(_chunks_sql("SELECT id, extracted_text AS t FROM v_documents", "\\n"))
def chunk_documents_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines instead of paragraphs are packed."""
    return text.chunks(views.documents(spark, d, status=False), separator="\n")


_DOUBLED = "replace(extracted_text, chr(10), chr(10) || ' ' || chr(9) || chr(10))"


@query(_chunks_sql(f"SELECT id, {_DOUBLED} AS t FROM v_documents", "\\n\\s*\\n"))
def chunk_documents_doubled(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a blank line, of blanks and a tab, between paragraphs."""
    docs = views.documents(spark, d, status=False)
    return text.chunks(docs.withColumn("extracted_text", F.replace("extracted_text", F.lit("\n"), F.lit("\n \t\n"))))


@query(r"SELECT id, len(list_filter(string_split(extracted_text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::BIGINT AS n FROM v_documents")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d, status=False).select("id", F.size(text.paragraphs(F.col("extracted_text"), "\n")).cast("long").alias("n"))


@query("SELECT id FROM v_documents WHERE status = 'Ready' AND trim(extracted_text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunk_eligible(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d).where((F.col("status") == "Ready") & ~is_blank(F.col("extracted_text"))).select("id")


_OCR = r"""
WITH l AS (SELECT id, page_number, i, string_split(string_split(tsv, chr(10))[i], chr(9)) AS c FROM v_ocr, range(2, 9) r(i) WHERE i <= len(string_split(tsv, chr(10)))),
w AS (SELECT id, page_number, i, c[12] AS word, TRY_CAST(c[11] AS DOUBLE) AS conf FROM l WHERE len(c) >= 12),
g AS (SELECT id, page_number, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n, round(avg(conf) / 100, 2) AS confidence FROM w WHERE conf >= 0 AND trim(word) <> '' GROUP BY id, page_number),
ocr AS (SELECT v.id, v.page_number, coalesce(text, '') AS text, coalesce(n, 0)::BIGINT AS word_count, coalesce(confidence, 0) AS confidence FROM v_ocr v LEFT JOIN g USING (id, page_number))
"""


def recognised(spark: SparkSession, d: str) -> DataFrame:
    pages = views.ocr_pages(spark, d).withColumn("w", text.words_of_tsv(F.col("tsv")))
    return pages.select("id", "page_number", text.page_text(F.col("w")).alias("text"), F.size("w").cast("long").alias("word_count"), text.page_confidence(F.col("w")).alias("confidence"))


@query(_OCR + "SELECT id, page_number, text, word_count FROM ocr")
def ocr_tsv_parse(spark: SparkSession, d: str) -> DataFrame:
    return recognised(spark, d).select("id", "page_number", "text", "word_count")


@query(_OCR + "SELECT id, page_number, word_count, confidence FROM ocr")
def ocr_page_confidence(spark: SparkSession, d: str) -> DataFrame:
    return recognised(spark, d).select("id", "page_number", "word_count", "confidence")


@query(_OCR + "SELECT id AS document_id, string_agg(text, chr(12) ORDER BY page_number) AS text, count(*)::BIGINT AS pages FROM ocr GROUP BY id")
def ocr_join_pages(spark: SparkSession, d: str) -> DataFrame:
    return text.joined_pages(recognised(spark, d).withColumnRenamed("id", "document_id"))


@query(f"""
SELECT id, CASE WHEN id % 3 = 0 THEN 'native' WHEN type = 'PDF' AND id % 2 = 0 OR id % 5 = 0 AND id % 2 = 0 THEN 'ocr' ELSE 'none' END AS route,
  CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 <> 0 AND type <> 'PDF' OR id % 2 = 1 THEN 'Failed' WHEN id % 4 = 0 THEN 'Needs Review' END AS status,
  CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 <> 0 AND type <> 'PDF' THEN '{text.NO_TEXT}' WHEN id % 2 = 1 THEN '{text.OCR_OFF}' WHEN id % 4 = 0 THEN '{text.NO_OCR_TEXT}' END AS error
FROM v_documents""")
def ocr_routing(spark: SparkSession, d: str) -> DataFrame:
    """Two of three documents have no native text; recognition is on for even ones and unset for some odd ones."""
    i = F.col("id")
    native, type_ = F.when(i % 3 == 0, F.col("extracted_text")).otherwise(" \n"), F.when(i % 5 == 0, "JPG").otherwise(F.col("type"))
    enabled, seen = F.when(i % 2 == 0, True).when(i % 7 != 0, False), F.when(i % 4 == 0, "\f").otherwise("words")
    out = views.documents(spark, d, status=False).select("id", text.routed(native, type_, enabled, F.replace(seen, F.lit("\f"), F.lit(" "))).alias("r"))
    return out.select("id", "r.*")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'vision' WHEN id % 4 = 1 AND type <> 'DOCX' THEN 'printed' WHEN type = 'DOCX' THEN 'vision' ELSE 'printed' END AS provider FROM v_documents")
def ocr_provider_choice(spark: SparkSession, d: str) -> DataFrame:
    """Workspace's choice, default, the rest; the printed engine can't read DOCX. Names that are not known count as none."""
    i = F.col("id")
    asked = F.when(i % 4 == 0, "vision").when(i % 4 == 1, "printed").when(i % 4 == 2, "unheard-of")
    return views.documents(spark, d, status=False).select("id", text.provider(asked, "printed", {"printed": F.col("type") != "DOCX", "vision": F.lit(True)}).alias("provider"))


@query("""SELECT sheet, '=== Sheet: ' || sheet || ' ===' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, line) AS text
FROM (SELECT l_orderkey AS sheet, l_linenumber, l_linenumber || ' | ' || l_partkey || ' | ' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS line FROM lineitem) GROUP BY sheet""")
def render_rows_piped(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of rows as text; an order is a sheet, its lines are rows."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), "l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return text.piped(rows, "sheet", "row", ["row", "l_partkey", "flag"])


@query("SELECT id, CASE WHEN id % 10 = 0 THEN '' WHEN id % 10 = 1 THEN NULL ELSE extracted_text END AS text, CASE WHEN id % 10 = 1 THEN 'Unsupported type: CSV' END AS error FROM v_documents")
def extract_dispatch(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    type_ = F.when(i % 10 == 0, "PNG").when(i % 10 == 1, "CSV").otherwise(F.col("type"))
    return views.documents(spark, d, status=False).select("id", text.extraction(F.col("extracted_text"), type_).alias("x")).select("id", "x.*")


PROMPTS = [("summary", 1, "Old: {{name}}", False), ("summary", 2, "Summarise {{name}}:\n{{text}}\nEnd of {{name}}.", True), ("risks", 1, "Risks of {{nothing}}", True), ("risks", 2, "Risks", False)]


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMPTS, "name string, version int, template string, active boolean")


def active_template(rows: DataFrame, name: str) -> str:
    """The template of a name's one active version; none or more than one is an error."""
    found = rows.where((F.col("name") == name) & F.col("active")).select("template").take(2)
    if len(found) != 1:
        raise LookupError(f"{name}: {len(found)} active prompts")
    return found[0][0]


@query("SELECT name, version, template FROM v_prompts WHERE active")
def prompt_active(spark: SparkSession, d: str) -> DataFrame:
    """The active version of every prompt."""
    return views.prompts(spark, d).where("active").select("name", "version", "template")


@query(f"""
SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE 'Summarise ' || name || ':' || chr(10) || extracted_text[1:{TEXT_CHARS}] || chr(10) || 'End of ' || name || '.' END AS text,
       CASE WHEN id % 10 = 0 THEN 'unresolved placeholder' END AS error, 'missing required variable: nothing' AS other FROM v_documents""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """A document whose text holds a placeholder can't be rendered."""
    rows, body = prompts(spark), F.substring("extracted_text", 1, TEXT_CHARS)
    values = {"name": F.col("name"), "text": F.when(F.col("id") % 10 == 0, F.concat(body, F.lit(" {{name}}"))).otherwise(body)}
    summary, risks = (text.rendered(active_template(rows, n), values) for n in ("summary", "risks"))
    return views.documents(spark, d, status=False).select("id", summary.alias("r"), risks["error"].alias("other")).select("id", "r.*", "other")
