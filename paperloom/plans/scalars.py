"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_blank, natural_key
from ..functions.rules import ENABLED_TYPES, FILE_TYPES, TEXT_CHARS
from ..sources import table, views
from .registry import query


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lower(c_name) || '@example.com' END AS email FROM customer")
def email_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Addresses without blanks around them, in lower case; null stays null."""
    from ..functions.columns import trimmed

    i = F.col("c_custkey")
    raw = F.when(i % 9 != 0, F.concat(F.lit("\t "), F.col("c_name"), F.lit("@Example.COM \r\n")))
    return table(spark, d, "customer").select(i.alias("id"), F.lower(trimmed(raw)).alias("email"))


@query(f"SELECT id, length(extracted_text[1:500])::BIGINT AS n, extracted_text[1:500] AS text, length(extracted_text[1:{TEXT_CHARS}])::BIGINT AS sent FROM v_documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    """The first characters (not bytes) of a text."""
    text = F.col("extracted_text")
    return views.documents(spark, d, status=False).select("id", F.length(F.substring(text, 1, 500)).cast("long").alias("n"), F.substring(text, 1, 500).alias("text"), F.length(F.substring(text, 1, TEXT_CHARS)).cast("long").alias("sent"))


@query("SELECT id, CASE WHEN id % 7 = 0 THEN true WHEN id % 7 = 1 THEN true WHEN id % 7 = 2 THEN false ELSE length(regexp_replace(extracted_text, '[ \\t\\n\\r]', '', 'g')) = 0 END AS blank FROM v_documents")
def blank_documents(spark: SparkSession, d: str) -> DataFrame:
    """Null, blanks of all kinds, and the text 0, which is not blank."""
    i = F.col("id")
    text = F.when(i % 7 == 1, " \t\r\n\0\x0b").when(i % 7 == 2, "0").when(i % 7 != 0, F.col("extracted_text"))
    return views.documents(spark, d, status=False).select("id", is_blank(text).alias("blank"))


@query("SELECT doc_id AS id, ceil(n_chars / 1024.0)::BIGINT AS size_kb FROM documents")
def size_kb(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d, status=False).select("id", "size_kb")


@query("SELECT id, lower(type) AS extension, CASE WHEN id % 4 <> 0 THEN type END AS type FROM v_documents")
def type_for_extension(spark: SparkSession, d: str) -> DataFrame:
    """The enabled type of an extension, in any case, with or without its dot; null for others."""
    i = F.col("id")
    extension = F.when(i % 4 == 0, "csv").when(i % 4 == 1, F.concat(F.lit("."), F.col("type"))).otherwise(F.lower("type"))
    plain = F.regexp_replace(F.lower(extension), r"^\.+", "")
    found = F.coalesce(*[F.when(plain.isin(*FILE_TYPES[t]), t) for t in ENABLED_TYPES])
    return views.documents(spark, d, status=False).select("id", F.lower("type").alias("extension"), found.alias("type"))


@query("""
SELECT o_custkey AS id, string_agg('scan' || (o_orderkey % 12) || '-page-' || (o_orderkey % 120) || '.png', ',' ORDER BY o_orderkey % 12, o_orderkey % 120, o_orderkey) AS files
FROM orders GROUP BY o_custkey""")
def natural_sort_pages(spark: SparkSession, d: str) -> DataFrame:
    """Files of each owner, scan2-page-10 before scan2-page-11 before scan10-page-1."""
    file = F.concat(F.lit("scan"), F.col("o_orderkey") % 12, F.lit("-page-"), F.col("o_orderkey") % 120, F.lit(".png"))
    listed = F.sort_array(F.collect_list(F.struct(natural_key(file).alias("n"), F.col("o_orderkey"), file.alias("f"))))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.transform(listed, lambda x: x["f"]), ",").alias("files"))


@query("SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, strftime(created_at, '%Y-%m-%d') AS day FROM v_documents")
def iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("created_at")
    return views.documents(spark, d, status=False).select("id", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("at"), F.date_format(at, "yyyy-MM-dd").alias("day"))


@query("SELECT id, coalesce(created_at + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-01 03:00:00', false) AS code_expired, coalesce(created_at + INTERVAL 30 DAY < TIMESTAMP '2024-02-01', false) AS token_expired FROM v_documents")
def expired_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes live 15 minutes, tokens 30 days; the time to compare with is a parameter, not the clock. Without a time nothing expires."""
    at = F.col("created_at")
    past = lambda c: F.coalesce(c, F.lit(False))
    return views.documents(spark, d, status=False).select("id", past(at + F.expr("interval 15 minutes") < F.expr("timestamp_ntz'2024-01-01 03:00:00'")).alias("code_expired"), past(at + F.expr("interval 30 days") < F.expr("timestamp_ntz'2024-02-01 00:00:00'")).alias("token_expired"))


@query("SELECT doc_id AS id, format('{:06d}', doc_id) AS code FROM documents")
def lpad_code(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d, status=False).select("id", F.lpad(F.col("id").cast("string"), 6, "0").alias("code"))


@query("SELECT id, CASE WHEN type = 'PDF' THEN name ELSE name || '.docx' END AS download_name FROM v_documents")
def download_name(spark: SparkSession, d: str) -> DataFrame:
    """The name with its extension; all that is not PDF gets docx."""
    extension = F.when(F.col("type") == "PDF", ".pdf").otherwise(".docx")
    has = F.lower("name").endswith(extension)
    return views.documents(spark, d, status=False).select("id", F.when(has, F.col("name")).otherwise(F.concat("name", extension)).alias("download_name"))
