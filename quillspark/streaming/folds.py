"""Incremental forms of the log folds, on Structured Streaming.

The source is the folder of event files; each run takes what is new
(available-now) and ends.  Sinks are idempotent: a batch that is run again
writes the same keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.registry import query
from quillspark.sources.folders import scratch


def stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """New rows of a table as they arrive (a folder of files, or one file)."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def run_once(df: DataFrame, mode: str, write) -> None:
    """Run all that is there through ``write(batch, id)``."""
    at = f"{scratch(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def collected(df: DataFrame, mode: str) -> DataFrame:
    """The rows a streaming query wrote, as a table; in update mode the last
    batch's row of a key stands, so each batch is a folder of its own."""
    spark, at = df.sparkSession, f"{scratch(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    run_once(df, mode, lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/batch={k}"))
    return spark.read.schema(df.schema.add("batch", "long")).parquet(at)


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL""")
def streamed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily windows under a watermark of ten days."""
    s = stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = collected(s.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total"), "update")
    last = rows.groupBy("day", "event_type").agg(F.max(F.struct("batch", "n", "total")).alias("l"))
    return last.select("day", "event_type", "l.n", F.round("l.total", 4).alias("total"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id""")
def streamed_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of each user, folded batch by batch."""
    s = stream(spark, folder).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"), F.count("*").alias("n"))
    rows = collected(s.select("user_id", F.col("l.event_type").alias("event_type"), "n"), "update")
    return rows.groupBy("user_id").agg(F.max_by("event_type", "batch").alias("event_type"), F.max_by("n", "batch").alias("n"))


@query("""SELECT user_id, event_id FROM events WHERE event_type = 'purchase'""")
def streamed_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Work done once though batches may be run again: each batch has a folder of
    its own, which another run of it writes anew, and what it brings is joined
    against what the batches before it have stored."""
    at = f"{scratch(spark)}/done-{uuid.uuid4().hex}"
    schema = "user_id long, event_id long"
    spark.createDataFrame([], schema).write.parquet(f"{at}/batch=-1")

    def work(batch: DataFrame, k: int) -> None:
        have = spark.read.schema(f"{schema}, batch long").parquet(at).where(F.col("batch") < k)  # what a run of this batch that died left is no reason to skip
        batch.select("user_id", "event_id").join(have, ["user_id", "event_id"], "left_anti").write.mode("overwrite").parquet(f"{at}/batch={k}")

    run_once(stream(spark, folder).where("event_type = 'purchase'"), "append", work)
    return spark.read.schema(f"{schema}, batch long").parquet(at).drop("batch")
