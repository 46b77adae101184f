"""Parquet tables of a folder, and the element model made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.arrays import offsets

DOCUMENT_ORDER = ("char_start", "seq")
FUNCTION_TYPES = ("EXPOSITION", "THEORY", "METHOD", None, "SYNTHESIS")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One element for each line: (document_id, seq, content, char_start, char_end).

    A leaf's text and its line end advance the offset, so that
    ``substring(text, char_start + 1, char_end - char_start)`` is the content.
    The offsets are summed within the row of the text: nothing is shuffled.
    """
    parts = df.select(F.col(doc_id).alias("document_id"), *keep, F.split(text, "\n").alias("parts"))
    parts = parts.withColumn("starts", offsets(F.transform("parts", lambda x: F.length(x) + 1)))
    each = parts.select("document_id", *keep, F.posexplode(F.arrays_zip("parts", "starts")).alias("seq", "p"))
    return each.select("document_id", *keep, "seq", F.col("p.parts").alias("content"), F.col("p.starts").alias("char_start"), (F.col("p.starts") + F.length("p.parts")).alias("char_end"))


def elements(df: DataFrame, longest_heading: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines typed as headings (short lines, with a level and sometimes a
    function) and paragraphs; empty lines are no elements."""
    e = lines(df, keep=keep).where("content <> ''")
    size = (F.col("char_end") - F.col("char_start")).cast("int")
    heading = size <= longest_heading
    kinds = F.element_at(F.array(*[F.lit(x) for x in FUNCTION_TYPES]), size % 5 + 1)
    return e.select(
        "document_id", *keep, "seq", "content", "char_start", "char_end",
        F.when(heading, "heading").otherwise("paragraph").alias("element_type"),
        F.when(heading, size % 3 + 1).cast("int").alias("level"),
        F.when(heading, kinds).alias("function_type"),
    )


#: The same elements in DuckDB, as the CTE ``e``.
ELEMENTS_SQL = """
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS seq FROM documents),
o AS (
  SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM l),
e AS (
  SELECT doc_id AS document_id, seq, content, char_start, char_start + length(content) AS char_end,
         CASE WHEN length(content) <= 40 THEN 'heading' ELSE 'paragraph' END AS element_type,
         CASE WHEN length(content) <= 40 THEN (length(content) % 3 + 1)::INTEGER END AS level,
         CASE WHEN length(content) <= 40 THEN (['EXPOSITION', 'THEORY', 'METHOD', NULL, 'SYNTHESIS'])[length(content) % 5 + 1] END AS function_type
  FROM o WHERE content <> '')
"""


def document_elements(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return elements(table(spark, folder, "documents"), keep=keep)
