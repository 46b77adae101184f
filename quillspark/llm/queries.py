"""One query for each operator of this subpackage, and its SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ann, decontamination, hard_negatives, html_extraction, importance_resampling, lexical_search, license_scan, mixing, ngram_join, quotation, sharding, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), good)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op7_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(_table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    files = docs.select("doc_id", path.alias("path"), "text")
    return license_scan.scan(files, "doc_id").withColumnRenamed("file_id", "doc_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_html_extraction, op2_toxicity, op3_decontamination, op4_importance_resampling, op5_ann,
        op6_substring_dedup, op7_quotation, op8_mixing, op9_license_scan, op10_ngram_join,
        op11_lexical_search, op12_hard_negatives, op13_sharding,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontamination.SQL,
        "op5_ann": ann.SQL,
        "op6_substring_dedup": substring_dedup.SQL,
        "op8_mixing": mixing.SQL,
        "op9_license_scan": license_scan.SQL,
        "op11_lexical_search": lexical_search.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
    }
