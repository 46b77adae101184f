"""Queries that join elements to ranges of any width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import intervals
from quillspark.operators import positions as pos
from quillspark.registry import query
from quillspark.sources.tables import ELEMENTS_SQL, document_elements

E = f"WITH {ELEMENTS_SQL}"
_UNITS = """t AS (SELECT *, max(char_end) OVER (PARTITION BY document_id) AS text_end FROM e), h AS (SELECT * FROM t WHERE element_type = 'heading'),
u AS (SELECT a.document_id, a.char_start AS unit_start, a.level, a.function_type, coalesce(min(b.char_start), any_value(a.text_end))::BIGINT AS unit_end
  FROM h a LEFT JOIN h b ON a.document_id = b.document_id AND b.char_start > a.char_start AND b.level <= a.level GROUP BY a.document_id, a.char_start, a.level, a.function_type)"""


def _units(e: DataFrame) -> DataFrame:
    """Units of headings as ranges, nested to any depth."""
    u = pos.unit_ends(e)
    return u.select("document_id", F.col("char_start").alias("unit_start"), F.col("unit_end").cast("long").alias("unit_end"), "level", "function_type")


@query(f"""{E}, {_UNITS}
SELECT e.document_id, e.char_start, u.unit_start, u.unit_end, u.level FROM e JOIN u ON e.document_id = u.document_id AND e.char_start >= u.unit_start AND e.char_start < u.unit_end WHERE e.element_type = 'paragraph'""")
def enclosing_units(spark: SparkSession, folder: str) -> DataFrame:
    """Each paragraph with all units that hold it, whatever their width."""
    e = document_elements(spark, folder).drop("content")
    p = e.where("element_type = 'paragraph'").select("document_id", "char_start")
    return intervals.matches(p, _units(e).drop("function_type"), "document_id", "char_start", "unit_start", "unit_end").select("document_id", "char_start", "unit_start", "unit_end", "level")


@query(f"""{E}, {_UNITS}
SELECT document_id, char_start, element_type FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.document_id = e.document_id AND u.function_type = 'THEORY' AND e.char_start >= u.unit_start AND e.char_start < u.unit_end)""")
def without_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Elements that are left when the units of one type are deleted by their ranges."""
    e = document_elements(spark, folder).drop("content")
    left = intervals.delete_covered(e, _units(e).where("function_type = 'THEORY'"), "document_id", "char_start", "unit_start", "unit_end")
    return left.select("document_id", "char_start", "element_type")


@query(f"""{E}, {_UNITS}, w AS (SELECT document_id, k * 700 AS w_start, k * 700 + 1000 AS w_end FROM (SELECT document_id, unnest(range(max(char_end) // 700 + 1)) AS k FROM e GROUP BY document_id))
SELECT u.document_id, u.unit_start, count(*) AS n_windows, min(w_start)::BIGINT AS first_window, max(w_end)::BIGINT AS last_end FROM u JOIN w ON u.document_id = w.document_id AND w_start < unit_end AND unit_start < w_end AND unit_end > unit_start GROUP BY ALL""")
def overlapping_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Units with the windows of a thousand characters that they overlap."""
    e = document_elements(spark, folder).drop("content")
    n = F.floor(F.max("char_end") / 700)
    w = e.groupBy("document_id").agg(F.sequence(F.lit(0).cast("long"), n).alias("k")).select("document_id", F.explode("k").alias("k")).select("document_id", (F.col("k") * 700).alias("w_start"), (F.col("k") * 700 + 1000).alias("w_end"))
    both = intervals.overlapping(_units(e).select("document_id", "unit_start", "unit_end"), w, "document_id", ("unit_start", "unit_end"), ("w_start", "w_end"))
    return both.groupBy("document_id", "unit_start").agg(F.count("*").alias("n_windows"), F.min("w_start").alias("first_window"), F.max("w_end").alias("last_end"))


_HITS = """c AS (SELECT document_id, block, list(char_start ORDER BY char_start) FILTER (WHERE element_type = 'paragraph' AND regexp_matches(content, '\\d')) AS hits
  FROM (SELECT *, sum((element_type = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY char_start) AS block FROM e) GROUP BY ALL)"""


def _containers(e: DataFrame) -> DataFrame:
    """(document_id, block, ranges): paragraphs with digits of each block, stored
    as an array of ranges that name an element."""
    hit = F.when((F.col("element_type") == "paragraph") & F.col("numeric"), F.struct(F.col("char_start").alias("element"), F.col("char_start").alias("start"), F.col("char_end").alias("end")))
    return pos.blocks(e).groupBy("document_id", "block").agg(F.array_sort(F.collect_list(hit)).alias("ranges")).where(F.size("ranges") > 0)


@query(f"""{E}, {_HITS}, x AS (SELECT document_id, block, unnest(hits) AS char_start FROM c)
SELECT document_id, block::BIGINT AS block, count(*) AS n_paragraphs, min(char_start) AS first_start, max(char_start) AS last_start FROM x GROUP BY ALL""")
def container_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of containers that are stored as ranges, matched by position."""
    e = document_elements(spark, folder).withColumn("numeric", F.col("content").rlike(r"\d")).drop("content")
    r = _containers(e).select("document_id", "block", F.explode("ranges").alias("r")).select("document_id", "block", "r.start", "r.end")
    p = e.where("element_type = 'paragraph'").select("document_id", "char_start")
    both = intervals.matches(p, r, "document_id", "char_start", "start", "end")
    return both.groupBy("document_id", "block").agg(F.count("*").alias("n_paragraphs"), F.min("char_start").alias("first_start"), F.max("char_start").alias("last_start"))


@query(f"""{E}, {_HITS} SELECT document_id, block::BIGINT AS block, len(hits)::INTEGER AS n_ranges FROM c WHERE len(hits) > 0 AND len(list_filter(hits, lambda h: h % 3 = 0)) = 0""")
def without_referring(spark: SparkSession, folder: str) -> DataFrame:
    """Containers that are left when those that refer to some elements are deleted."""
    e = document_elements(spark, folder).withColumn("numeric", F.col("content").rlike(r"\d")).drop("content")
    c = _containers(e).withColumn("ranges", F.transform("ranges", lambda r: F.struct(F.concat_ws(":", F.col("document_id"), r["element"]).alias("element"))))
    gone = e.where("char_start % 3 = 0").select(F.concat_ws(":", "document_id", "char_start").alias("gone"))
    left = intervals.delete_referring(c, ["document_id", "block"], "ranges", "element", gone, "gone")
    return left.select("document_id", "block", F.size("ranges").alias("n_ranges"))
