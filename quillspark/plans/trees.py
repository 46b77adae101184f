"""Queries over trees of elements: flattening, references, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.arrays import offsets
from quillspark.operators.collapse import collapse
from quillspark.registry import query
from quillspark.sources import trees
from quillspark.sources.folders import written
from quillspark.sources.tables import ELEMENTS_SQL, table

E = f"WITH {ELEMENTS_SQL}"
_TREE = """x AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY char_start) - 1)::INTEGER AS idx, coalesce(level, 99) AS lv FROM e),
r AS (SELECT a.document_id, a.idx, max(b.idx) AS parent FROM x a LEFT JOIN x b ON b.document_id = a.document_id AND b.idx < a.idx AND b.level < a.lv
  AND NOT EXISTS (SELECT 1 FROM x c WHERE c.document_id = a.document_id AND c.idx > b.idx AND c.idx < a.idx AND c.level <= b.level) GROUP BY ALL)"""


def _kinds(text: Column) -> tuple[Column, Column]:
    """Levels of the lines of a text that are not empty (null for paragraphs),
    and the lines themselves, both within the row."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.when(F.length(x) <= 40, (F.length(x) % 3 + 1).cast("int"))), lines


@query(None)
def page_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The elements of pages in pre-order, with parents and ids."""
    return trees.page_elements(table(spark, folder, "pages")).drop("text", "refs")


@query(None)
def page_references(spark: SparkSession, folder: str) -> DataFrame:
    """References between elements of pages, resolved to ids."""
    return trees.references(trees.page_elements(table(spark, folder, "pages")))


@query(f"""{E}, {_TREE} SELECT document_id, idx, parent, (row_number() OVER (PARTITION BY document_id, parent ORDER BY idx) - 1)::INTEGER AS sibling FROM r""")
def element_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of documents as a tree: headings by their levels, paragraphs
    as leaves of the heading before them."""
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "document_id")
    return trees.level_tree(docs, _kinds(F.col("text"))[0], "document_id").drop("depth")


@query(f"""{E}, {_TREE},
n AS (SELECT r.document_id, r.idx, r.parent, length(content)::BIGINT AS size, content, char_start, level FROM r JOIN x USING (document_id, idx) UNION ALL SELECT DISTINCT document_id, -1, NULL, 0, '', -1, 0 FROM e),
c AS (WITH RECURSIVE up(document_id, idx, above) AS (
    SELECT document_id, idx, CASE WHEN idx = -1 THEN NULL ELSE coalesce(parent, -1) END FROM n
    UNION ALL SELECT u.document_id, u.idx, CASE WHEN u.above = -1 THEN NULL ELSE coalesce(p.parent, -1) END FROM up u JOIN n p ON p.document_id = u.document_id AND p.idx = u.above WHERE u.above IS NOT NULL)
  SELECT document_id, above AS node, idx FROM up WHERE above IS NOT NULL UNION ALL SELECT document_id, idx, idx FROM n),
v AS (SELECT c.document_id, c.node, c.idx, n.size, n.content, n.char_start, n.level, NOT EXISTS (SELECT 1 FROM r k WHERE k.document_id = c.document_id AND coalesce(k.parent, -1) = c.idx) AS leaf
  FROM c JOIN n ON n.document_id = c.document_id AND n.idx = c.idx)
SELECT document_id, node::INTEGER AS node, count(*) - 1 AS n_below, sum(size)::BIGINT AS total, arg_max(size, char_start) FILTER (WHERE size % 2 = 0)::BIGINT AS latest_even,
  string_agg(substring(content, 1, 3), '|' ORDER BY char_start) FILTER (WHERE leaf) AS joined FROM v GROUP BY ALL""")
def collapsed_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs, sections, chapters and works reduced level by level: sums,
    the latest even value and the joined beginnings of what is below."""
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "document_id").where(F.length("text") > 0)
    levels, lines = _kinds(F.col("text"))
    flat = trees.level_tree(docs.where(F.size(lines) > 0), levels, "document_id", "text")
    starts = F.filter(F.transform(F.arrays_zip(F.split("text", "\n").alias("l"), offsets(F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)).alias("s")), lambda p: F.struct(F.col("document_id"), p["l"].alias("l"), p["s"].alias("s"))), lambda p: p["l"] != "")
    own = docs.select("document_id", F.posexplode(starts).alias("idx", "p")).select("document_id", "idx", F.length("p.l").cast("long").alias("size"), F.substring("p.l", 1, 3).alias("label"), F.col("p.s").alias("at"))
    nodes = flat.drop("text").join(own, ["document_id", "idx"]).select("document_id", F.col("idx").alias("node"), F.coalesce("parent", F.lit(-1)).alias("parent"), (F.col("depth") + 1).alias("depth"), "at", F.col("size").alias("value"), "label")
    works = nodes.select("document_id").distinct().select("document_id", F.lit(-1).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("depth"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("value"), F.lit("").alias("label"))
    both = written(nodes.unionByName(works), "nodes")  # each level reads them
    out = collapse(both, "document_id", "|", latest=F.when(F.col("value") % 2 == 0, F.col("value")))
    return out.select("document_id", "node", "n_below", "total", F.col("latest").alias("latest_even"), "joined")
