"""Outlines as they stand after what users have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markers
from quillspark.operators import positions as pos
from quillspark.operators import review
from quillspark.registry import query
from quillspark.sources.tables import ELEMENTS_SQL, document_elements, table

E = f"WITH {ELEMENTS_SQL}"
W = "PARTITION BY document_id ORDER BY char_start"
# Assessed documents have overrides: by the place of a heading, else by its text.
_OVERRIDES = """b AS (SELECT document_id, char_start AS at_start, NULL AS label, 1 AS user_level, NULL AS user_text, false AS out_, NULL AS user_type FROM h0 WHERE char_start % 5 = 0 AND quality = 1
  UNION ALL SELECT document_id, char_start, NULL, NULL, NULL, true, NULL FROM h0 WHERE char_start % 7 = 1 AND char_start % 5 <> 0
  UNION ALL SELECT document_id, NULL, content, 2, 'T: ' || content, false, 'EXKURS' FROM (SELECT DISTINCT document_id, content FROM h0 WHERE length(content) % 4 = 0))"""
_RESOLVED = f"""h0 AS (SELECT e.*, quality FROM e JOIN labels ON doc_id = document_id WHERE element_type = 'heading'), hs AS (SELECT * FROM e WHERE element_type = 'heading'), {_OVERRIDES},
r AS (SELECT h.document_id, h.char_start, coalesce(p.user_text, l.user_text, h.content) AS heading, CASE WHEN p.at_start IS NOT NULL THEN coalesce(p.user_level, h.level) ELSE coalesce(l.user_level, h.level) END AS level,
    CASE WHEN p.at_start IS NOT NULL THEN p.out_ ELSE coalesce(l.out_, false) END AS excluded, CASE WHEN p.at_start IS NOT NULL THEN p.user_type ELSE l.user_type END AS user_type, h.function_type
  FROM hs h LEFT JOIN b p ON p.document_id = h.document_id AND p.at_start = h.char_start LEFT JOIN b l ON l.document_id = h.document_id AND l.label = h.content AND p.at_start IS NULL),
k AS (SELECT * FROM r WHERE NOT excluded), g AS (SELECT *, sum((level < 2)::INT) OVER ({W}) AS g2, sum((level < 3)::INT) OVER ({W}) AS g3 FROM k),
n AS (SELECT *, sum((level = 1)::INT) OVER ({W}) AS n1, sum((level = 2)::INT) OVER (PARTITION BY document_id, g2 ORDER BY char_start) AS n2, sum((level = 3)::INT) OVER (PARTITION BY document_id, g3 ORDER BY char_start) AS n3 FROM g),
ends AS (SELECT document_id, max(char_end) AS text_end FROM e GROUP BY document_id)"""


def _overrides(spark: SparkSession, folder: str, h: DataFrame) -> DataFrame:
    """(document_id, at_start, label, user_level, user_text, excluded, user_type)."""
    some = h.join(table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), "quality"), "document_id")
    at, none = F.col("char_start"), lambda t: F.lit(None).cast(t)
    place = some.where(((at % 5 == 0) & (F.col("quality") == 1)) | (at % 7 == 1) & (at % 5 != 0))
    by_place = place.select("document_id", at.alias("at_start"), none("string").alias("label"), F.when(at % 5 == 0, 1).alias("user_level"), none("string").alias("user_text"), (at % 5 != 0).alias("excluded"), none("string").alias("user_type"))
    by_text = some.where(F.length("content") % 4 == 0).select("document_id", "content").distinct()
    return by_place.unionByName(by_text.select("document_id", none("long").alias("at_start"), F.col("content").alias("label"), F.lit(2).alias("user_level"), F.concat(F.lit("T: "), "content").alias("user_text"), F.lit(False).alias("excluded"), F.lit("EXKURS").alias("user_type")))


def effective(h: DataFrame, overrides: DataFrame) -> DataFrame:
    """Headings (document_id, char_start, char_end, content, level, ...) with what
    users have set, by place, else by text: ``heading``, ``level``, ``excluded``
    and ``user_type``."""
    o = overrides.withColumn("set", F.struct("user_level", "user_text", "excluded", "user_type"))
    keyed = h.withColumn("at_start", F.col("char_start")).withColumn("label", F.col("content"))
    j = review.two_key_lookup(keyed, o.select("document_id", "at_start", "label", "set"), ["document_id", "at_start"], ["document_id", "label"], "set")
    return j.select(
        *[c for c in h.columns if c != "level"], F.coalesce("set.user_text", "content").alias("heading"), F.coalesce("set.user_level", "level").alias("level"), F.coalesce("set.excluded", F.lit(False)).alias("excluded"), F.col("set.user_type").alias("user_type")
    )


def _resolved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = document_elements(spark, folder)
    h = e.where(pos.is_heading())
    return effective(h, _overrides(spark, folder, h)), e


@query(f"""{E}, {_RESOLVED}
SELECT r.document_id, r.char_start, r.heading, r.level, r.excluded, CASE r.level WHEN 1 THEN n1::VARCHAR WHEN 2 THEN n1 || '.' || n2 ELSE n1 || '.' || n2 || '.' || n3 END AS numbering, coalesce(r.user_type, r.function_type) AS type
FROM r LEFT JOIN n ON n.document_id = r.document_id AND n.char_start = r.char_start""".replace("CASE r.level WHEN 1", "CASE WHEN n.level IS NULL THEN NULL WHEN r.level = 1").replace("WHEN 2 THEN n1 || '.' || n2 ELSE n1", "WHEN r.level = 2 THEN n1 || '.' || n2 ELSE n1"))
def effective_outline(spark: SparkSession, folder: str) -> DataFrame:
    """The outline that counts: levels, texts and types as users have set them,
    excluded headings, and numbers of the others."""
    r, _ = _resolved(spark, folder)
    return pos.numbering(r).select("document_id", "char_start", "heading", "level", "excluded", "numbering", F.coalesce("user_type", "function_type").alias("type"))


@query(f"""{E}, {_RESOLVED}, u AS (SELECT a.document_id, a.char_start AS unit_start, a.heading, a.level, coalesce(min(z.char_start), any_value(text_end))::BIGINT AS unit_end
  FROM k a JOIN ends USING (document_id) LEFT JOIN k z ON z.document_id = a.document_id AND z.char_start > a.char_start AND z.level <= a.level GROUP BY ALL)
SELECT u.document_id, u.unit_start, u.heading, u.unit_end, count(p.char_start) AS n_paragraphs, coalesce(sum(length(p.content)), 0)::BIGINT AS n_chars FROM u LEFT JOIN e p ON p.document_id = u.document_id AND p.element_type = 'paragraph' AND p.char_start >= u.unit_start AND p.char_start < u.unit_end
WHERE u.level = 1 GROUP BY ALL""")
def effective_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of the outline that counts, with the paragraphs in them."""
    from quillspark.operators import intervals

    r, e = _resolved(spark, folder)
    rows = r.where("not excluded").select("document_id", "char_start", "char_end", "heading", "level", F.lit("heading").alias("element_type"))
    ends = e.groupBy("document_id").agg(F.max("char_end").alias("_end")).select("document_id", F.col("_end").alias("char_start"), F.col("_end").alias("char_end"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("level"), F.lit("end").alias("element_type"))
    u = pos.unit_ends(rows.unionByName(ends)).where("level = 1").select("document_id", F.col("char_start").alias("unit_start"), "heading", F.col("unit_end").cast("long").alias("unit_end"))
    p = e.where("element_type = 'paragraph'").select("document_id", "char_start", pos.n_chars().alias("size"))
    n = intervals.matches(p, u.select("document_id", "unit_start", "unit_end"), "document_id", "char_start", "unit_start", "unit_end").groupBy("document_id", "unit_start").agg(F.count("*").alias("n_paragraphs"), F.sum("size").cast("long").alias("n_chars"))
    return u.join(n, ["document_id", "unit_start"], "left").fillna(0, ["n_paragraphs", "n_chars"])


_RULED = " ".join(f"WHEN regexp_matches(heading, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{kind}'" for p, kind, _ in markers.HEADING_RULES)


@query(f"""{E}, {_RESOLVED} SELECT document_id, count(*) FILTER (WHERE NOT excluded) AS n_headings, count(*) FILTER (WHERE excluded) AS n_excluded, count(*) FILTER (WHERE user_type IS NOT NULL AND NOT excluded) AS n_user, count(*) FILTER (WHERE NOT excluded AND user_type IS NULL AND (CASE {_RULED} END) IS NOT NULL) AS n_ruled,
  count(*) FILTER (WHERE NOT excluded AND user_type IS NULL AND (CASE {_RULED} END) IS NULL) AS n_open FROM r GROUP BY document_id""")
def outline_review(spark: SparkSession, folder: str) -> DataFrame:
    """How far the headings of a document are settled: set by users, typed by
    their words, and open."""
    r, _ = _resolved(spark, folder)
    in_, user = ~F.col("excluded"), F.col("user_type").isNotNull()
    ruled = markers.heading_type(F.col("heading")).isNotNull()
    return r.groupBy("document_id").agg(F.count_if(in_).alias("n_headings"), F.count_if("excluded").alias("n_excluded"), F.count_if(in_ & user).alias("n_user"), F.count_if(in_ & ~user & ruled).alias("n_ruled"), F.count_if(in_ & ~user & ~ruled).alias("n_open"))
