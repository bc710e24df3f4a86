"""The operators' queries over the tables of a data folder, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bm25, filter_audit, html_text, lang_crf, mixing, neardup, pii, quality, repeats, runs, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.score(docs, model).withColumn("held_out", quality.held_out())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents"), content=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(runs.collapsed(_table(spark, sf_dir, "documents"), altered=runs.tail_of_one_period))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.replay(filter_audit.flags(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_crf.fit(docs.where(~lang_crf.held_out()))
    return lang_crf.label(docs, model).select("doc_id", lang_crf.held_out().alias("held_out"), "lang_pred", "score", "spans")


QUERIES = {
    "op1_quality": op1_quality,
    "op8_toxicity": op8_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_html_text": op3_html_text,
    "op4_minhash": op4_minhash,
    "op5_topk": op5_topk,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_array": op10_suffix_array,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_id": op13_language_id,
}
ORACLES = {
    "op5_topk": topk.ORACLE,
    "op7_mixing": f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})",
    "op9_url_filter": url_filter.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
