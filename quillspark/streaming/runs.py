"""Queries over streams with a state store, rows that fail, and progress."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.registry import query
from quillspark.sources.folders import scratch
from quillspark.sources.tables import table
from quillspark.streaming import poison, progress, stateful
from quillspark.streaming.arrivals import Arrivals


def stacked(spark: SparkSession, df: DataFrame, parts: int, idle: str | None = None) -> DataFrame:
    """(key, depth, current, closed, batch) of every batch, as ``df`` arrives in
    parts; each part is a run of its own, which goes on from the stored state."""
    arriving = Arrivals(df, "event_id", parts)
    at = f"{scratch(spark)}/stacks-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={k}")

    with stateful.rocks(spark):
        for part in range(parts):
            arriving.add(part)
            e = arriving.stream().withColumn("kind", F.when(F.col("event_type") == "signup", "origin").otherwise("re_spec")).withColumn("anchors", F.array("event_type"))
            out = stateful.version_stacks(e, "user_id", "event_id", "ts", "anchors", "value", idle=idle)
            out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    kind = df.schema["user_id"].dataType.simpleString()
    return spark.read.schema(f"key {kind}, depth long, current double, closed boolean, batch long").parquet(f"{at}/rows")


@query("""WITH s AS (SELECT user_id, CASE WHEN event_type = 'signup' THEN 'origin' ELSE event_type END AS k, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT user_id, count(*) AS depth, coalesce(arg_max(value, event_id) FILTER (WHERE k <> 'origin'), arg_max(value, event_id) FILTER (WHERE k = 'origin')) AS current FROM s GROUP BY user_id""")
def streamed_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """Version stacks kept in a state store while events arrive in three parts."""
    rows = stacked(spark, table(spark, folder, "events"), 3)
    last = rows.groupBy("key").agg(F.max(F.struct("batch", "depth", "current")).alias("l"))
    return last.select(F.col("key").alias("user_id"), "l.depth", "l.current")


def _ascii_words(text: str) -> int:
    """Words of a text of plain ASCII."""
    for k, c in enumerate(text):
        if ord(c) > 127:
            raise ValueError(f"character {ord(c)} at {k}")
    return len(text.split())


def _latin_words(text: str) -> int:
    """Words of a text of Latin-1 characters."""
    for k, c in enumerate(text):
        if ord(c) > 255:
            raise ValueError(f"character {ord(c)} at {k}")
    return len(text.split())


_BAD = "regexp_extract(text, '(?s)^([\\x{{0}}-\\x{{{0}}}]*)', 1)"


@query(rf"""WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^\s\x1c-\x1f\x85\xa0]+'))::BIGINT AS words, {_BAD.format('7F')} AS plain, {_BAD.format('FF')} AS latin FROM documents)
SELECT doc_id, CASE WHEN length(latin) = length(text) THEN 'good' ELSE 'bad' END AS state, CASE WHEN length(plain) = length(text) THEN 1 ELSE 2 END AS attempt, CASE WHEN length(latin) = length(text) THEN words END AS words,
  CASE WHEN length(latin) < length(text) THEN 'ValueError: character ' || unicode(substring(text, length(latin) + 1, 1)) || ' at ' || length(latin) END AS reason FROM d""")
def retried_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read by a strict parser; those that fail are set aside with
    their reason and tried again by a wider one, and the rest stays aside."""
    docs = table(spark, folder, "documents")
    intake = poison.Intake(docs, "doc_id", "text", "bigint")
    intake.run(_ascii_words)
    intake.run(_latin_words)
    good = intake.good().select("doc_id", F.lit("good").alias("state"), "attempt", F.col("result").alias("words"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(intake.open().select("doc_id", F.lit("bad").alias("state"), "attempt", F.lit(None).cast("long").alias("words"), "reason"))


PHASES = ("read", "valued", "bought")


def observed(spark: SparkSession, df: DataFrame, parts: int) -> DataFrame:
    """(part, phase, n_rows, total) as rows arrive in parts."""
    arriving = Arrivals(df, "event_id", parts)
    at = f"{scratch(spark)}/observed-{uuid.uuid4().hex}"
    out = None
    for part in range(parts):
        arriving.add(part)
        name = f"part-{part}-{uuid.uuid4().hex}"
        told = progress.Progress(name)
        spark.streams.addListener(told)
        try:
            rows = progress.phase(arriving.stream(), "read", "value")
            rows = progress.phase(rows.where("value >= 10"), "valued", "value")
            rows = progress.phase(rows.where("event_type = 'purchase'"), "bought", "value")
            rows.writeStream.queryName(name).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
            told.wait(spark)
        finally:
            spark.streams.removeListener(told)
        one = told.table(spark).withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH e AS (SELECT value, event_type, (event_id - (SELECT min(event_id) FROM events)) * 3 // (SELECT max(event_id) - min(event_id) + 1 FROM events) AS part FROM events),
u AS (SELECT part, 'read' AS phase, value FROM e UNION ALL SELECT part, 'valued', value FROM e WHERE value >= 10 UNION ALL SELECT part, 'bought', value FROM e WHERE value >= 10 AND event_type = 'purchase')
SELECT part::INTEGER AS part, phase, count(*) AS n_rows, round(sum(value), 4)::DOUBLE AS total FROM u GROUP BY ALL""")
def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """What passed each phase of each part of a stream, as its listener was told."""
    rows = observed(spark, table(spark, folder, "events"), 3)
    return rows.groupBy("part", "phase").agg(F.sum("n_rows").alias("n_rows"), F.round(F.sum("total"), 4).alias("total"))
