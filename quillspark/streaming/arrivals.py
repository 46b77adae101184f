"""A table as it arrives: its rows written to a folder in parts, one after the
other, for streams that take what is new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.folders import scratch


class Arrivals:
    """Parts 0, 1, … of ``df`` by ranges of the whole number ``by``."""

    def __init__(self, df: DataFrame, by: str, parts: int) -> None:
        ends = df.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
        low, size = ends["a"] or 0, (ends["b"] or 0) - (ends["a"] or 0) + 1
        self.spark: SparkSession = df.sparkSession
        self.rows, self.schema, self.parts = df.withColumn("_part", F.floor((F.col(by) - low) * parts / size)), df.schema, parts
        self.folder = f"{scratch(self.spark)}/arrivals-{uuid.uuid4().hex}"
        self.rows.drop("_part").where("false").write.parquet(self.folder)

    def add(self, part: int) -> None:
        self.rows.where(F.col("_part") == part).drop("_part").write.mode("append").parquet(self.folder)

    def stream(self, **options) -> DataFrame:
        return self.spark.readStream.schema(self.schema).options(**options).parquet(self.folder)
