"""A corpus cleaned and mixed in five stages.

Each stage reads all that its predecessor kept; all but the last return the
columns of ``documents``:

1. toxicity: documents predicted toxic go;
2. ngram_join: of each class of near copies the document with the least id
   stays;
3. substring_dedup: words of windows that begin earlier go from the texts, and
   documents of which nothing is left;
4. decontamination: documents that share a window with a benchmark item go;
5. mixing: the words each document gives to the mix.

No oracle: the first stage fits a model, which SQL does not express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, mixing, ngram_join, substring_dedup, toxicity
from quillspark.llm.common import cut


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_documents(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("ngram_join", _ngram_join),
    ("substring_dedup", _substring_dedup),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
