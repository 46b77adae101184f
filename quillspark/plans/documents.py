"""Queries over the elements of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import positions as pos
from quillspark.registry import query
from quillspark.sources.tables import ELEMENTS_SQL, FUNCTION_TYPES, document_elements, table

E = f"WITH {ELEMENTS_SQL}"
W = "PARTITION BY document_id ORDER BY char_start"
P = "SELECT * FROM e WHERE element_type = 'paragraph'"


@query(f"""{E}, b AS (SELECT *, sum((element_type = 'heading')::INT) OVER ({W}) AS block FROM e)
SELECT document_id, block::BIGINT AS block, min(char_start) AS block_start, count(*) FILTER (WHERE element_type = 'paragraph') AS n_paragraphs,
       sum(length(content))::BIGINT AS n_chars, count(*) FILTER (WHERE regexp_matches(content, '\\d')) AS n_numeric
FROM b GROUP BY document_id, block""")
def elements_by_document(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks between headings: paragraphs, characters and lines with digits."""
    b = pos.blocks(document_elements(spark, folder).withColumn("numeric", F.col("content").rlike(r"\d")).drop("content"))
    return b.groupBy("document_id", "block").agg(
        F.min("char_start").alias("block_start"), F.count_if(~pos.is_heading()).alias("n_paragraphs"),
        F.sum(pos.n_chars()).cast("long").alias("n_chars"), F.count_if("numeric").alias("n_numeric"),
    )


_NEAR = f"""{E}, n AS (
  SELECT *, last_value(CASE WHEN {{seen}} THEN char_start END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS heading_start,
         last_value(CASE WHEN {{seen}} THEN function_type END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS heading_type FROM e)
SELECT document_id, char_start, heading_start, heading_type FROM n WHERE element_type = 'paragraph' AND heading_type = 'THEORY'"""


@query(_NEAR.format(seen="function_type IS NOT NULL"))
def asof_filter_after(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs whose nearest typed heading is of type THEORY."""
    n = pos.nearest_heading(document_elements(spark, folder)).where("heading_type = 'THEORY'")
    return n.select("document_id", "char_start", "heading_start", "heading_type")


@query(_NEAR.format(seen="function_type = 'THEORY'"))
def asof_filter_before(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs after any heading of type THEORY, with the nearest such."""
    n = pos.nearest_heading(document_elements(spark, folder), only="THEORY")
    return n.select("document_id", "char_start", "heading_start", "heading_type")


@query(f"""{E}, n AS (
  SELECT *, last_value(CASE WHEN element_type = 'heading' THEN char_start END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS direct_start,
         last_value(function_type IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS container_type FROM e)
SELECT document_id, char_start, direct_start, container_type FROM n WHERE element_type = 'paragraph'""")
def asof_dual(spark: SparkSession, folder: str) -> DataFrame:
    return pos.dual_heading(document_elements(spark, folder)).select("document_id", "char_start", "direct_start", "container_type")


@query(f"""{E}, t AS (SELECT *, max(char_end) OVER (PARTITION BY document_id) AS text_end FROM e)
SELECT document_id, char_start, coalesce(lead(char_start) OVER ({W}), text_end)::BIGINT AS next_start FROM t WHERE element_type = 'heading'""")
def asof_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Headings with the start of the next one."""
    return pos.next_heading(document_elements(spark, folder)).select("document_id", "char_start", "next_start")


@query(f"""{E}, t AS (SELECT *, max(char_end) OVER (PARTITION BY document_id) AS text_end FROM e), h AS (SELECT * FROM t WHERE element_type = 'heading')
SELECT a.document_id, a.char_start, a.level, coalesce(min(b.char_start), any_value(a.text_end))::BIGINT AS unit_end
FROM h a LEFT JOIN h b ON a.document_id = b.document_id AND b.char_start > a.char_start AND b.level <= a.level
GROUP BY a.document_id, a.char_start, a.level""")
def unit_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Where the unit of each heading ends."""
    return pos.unit_ends(document_elements(spark, folder)).select("document_id", "char_start", "level", F.col("unit_end").cast("long").alias("unit_end"))


@query(f"""{E}, t AS (SELECT *, max(char_end) OVER (PARTITION BY document_id) AS text_end FROM e), h AS (SELECT * FROM t WHERE level = 1),
c AS (SELECT document_id, char_start AS unit_start, coalesce(lead(char_start) OVER ({W}), text_end) AS unit_end FROM h)
SELECT c.document_id, c.unit_start, c.unit_end::BIGINT AS unit_end, count(p.char_start) AS n_paragraphs, coalesce(sum(length(p.content)), 0)::BIGINT AS n_chars
FROM c LEFT JOIN ({P}) p ON p.document_id = c.document_id AND p.char_start >= c.unit_start AND p.char_start < c.unit_end GROUP BY ALL""")
def chapter_units(spark: SparkSession, folder: str) -> DataFrame:
    """Level-1 units with the paragraphs inside (a range join as an as-of match)."""
    e = document_elements(spark, folder)
    e = e.withColumn("text_end", F.max("char_end").over(Window.partitionBy("document_id")))
    e = e.withColumn("unit_start", F.last(F.when(F.col("level") == 1, F.col("char_start")), ignorenulls=True).over(pos.upto(pos.order())))
    e = e.withColumn("unit_end", F.coalesce(F.min(F.when(F.col("level") == 1, F.col("char_start"))).over(pos.after(pos.order())), F.col("text_end"))).where("unit_start is not null")
    para = F.col("element_type") == "paragraph"
    return e.groupBy("document_id", "unit_start").agg(F.max("unit_end").cast("long").alias("unit_end"), F.count_if(para).alias("n_paragraphs"), F.coalesce(F.sum(F.when(para, pos.n_chars())), F.lit(0)).cast("long").alias("n_chars"))


@query(f"""{E}, h AS (SELECT *, sum((level < 2)::INT) OVER ({W}) AS g2, sum((level < 3)::INT) OVER ({W}) AS g3 FROM e WHERE element_type = 'heading'),
n AS (SELECT *, sum((level = 1)::INT) OVER ({W}) AS n1, sum((level = 2)::INT) OVER (PARTITION BY document_id, g2 ORDER BY char_start) AS n2,
        sum((level = 3)::INT) OVER (PARTITION BY document_id, g3 ORDER BY char_start) AS n3 FROM h)
SELECT document_id, char_start, CASE level WHEN 1 THEN n1::VARCHAR WHEN 2 THEN n1 || '.' || n2 ELSE n1 || '.' || n2 || '.' || n3 END AS numbering FROM n""")
def outline_numbering(spark: SparkSession, folder: str) -> DataFrame:
    return pos.numbering(document_elements(spark, folder)).select("document_id", "char_start", "numbering")


@query(f"""{E}, p AS ({P})
SELECT document_id, char_start, row_number() OVER ({W})::BIGINT AS n, lag(char_start) OVER ({W}) AS previous_start, lead(char_start) OVER ({W}) AS next_start FROM p""")
def paragraph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph numbers with the paragraphs before and after."""
    p, w = document_elements(spark, folder).where("element_type = 'paragraph'"), pos.order()
    return p.select("document_id", "char_start", F.row_number().over(w).cast("long").alias("n"), F.lag("char_start").over(w).alias("previous_start"), F.lead("char_start").over(w).alias("next_start"))


@query(f"""{E}, b AS (SELECT *, sum((element_type = 'heading')::INT) OVER ({W}) AS block FROM e)
SELECT document_id, char_start, block::BIGINT AS block, row_number() OVER (PARTITION BY document_id, block ORDER BY char_start)::BIGINT AS n_in_block,
       (count(*) OVER (PARTITION BY document_id, block ORDER BY char_start) - 1)::BIGINT AS n_prior,
       coalesce(sum(length(content)) OVER (PARTITION BY document_id, block ORDER BY char_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_chars
FROM b WHERE element_type = 'paragraph'""")
def prior_in_unit(spark: SparkSession, folder: str) -> DataFrame:
    """What stands before each paragraph in its unit."""
    p = pos.blocks(document_elements(spark, folder)).where("element_type = 'paragraph'")
    w = Window.partitionBy("document_id", "block").orderBy("char_start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(w).cast("long")
    return p.select("document_id", "char_start", "block", n.alias("n_in_block"), (n - 1).alias("n_prior"), F.coalesce(F.sum(pos.n_chars()).over(before), F.lit(0)).cast("long").alias("prior_chars"))


@query(f"""{E}, d AS (
  SELECT *, last_value(CASE WHEN element_type = 'heading' THEN char_start END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS direct_start,
         last_value(function_type IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS container_type FROM e),
p AS (SELECT *, row_number() OVER ({W}) AS n, direct_start || ':' || (container_type IS NOT NULL) AS k FROM d WHERE element_type = 'paragraph'),
c AS (SELECT *, CASE WHEN n = 1 OR k IS DISTINCT FROM lag(k) OVER ({W}) THEN 1 ELSE 0 END AS change FROM p),
r AS (SELECT *, sum(change) OVER ({W}) AS run FROM c)
SELECT document_id, run::BIGINT AS run, min(direct_start) AS heading_start, min(container_type) AS container_type, count(*) AS n_paragraphs, min(char_start) AS first_start
FROM r WHERE container_type IS NOT NULL GROUP BY document_id, run""")
def complex_walk(spark: SparkSession, folder: str) -> DataFrame:
    return pos.complexes(document_elements(spark, folder))


@query(f"""{E}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY char_start DESC) AS back, count(*) OVER (PARTITION BY document_id) AS n FROM ({P}))
SELECT document_id, char_start FROM p WHERE back <= greatest(1, ceil(n / 3.0))""")
def last_third(spark: SparkSession, folder: str) -> DataFrame:
    p = document_elements(spark, folder).where("element_type = 'paragraph'")
    back = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("char_start")))
    n = F.count("*").over(Window.partitionBy("document_id"))
    return p.withColumn("back", back).withColumn("n", n).where(F.col("back") <= F.greatest(F.lit(1), F.ceil(F.col("n") / 3))).select("document_id", "char_start")


@query(f"""{E}, h AS (SELECT *, row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY document_id) AS total FROM e WHERE level = 1)
SELECT document_id, char_start, CASE WHEN function_type IS NOT NULL THEN function_type WHEN n = 1 THEN 'EXPOSITION' WHEN n = total THEN 'SYNTHESIS' END AS suggested,
       CASE WHEN function_type IS NOT NULL THEN 0.95 WHEN n = 1 OR n = total THEN 0.6 END::DOUBLE AS confidence FROM h""")
def suggested_types(spark: SparkSession, folder: str) -> DataFrame:
    """Own type, else by position: first and last top-level heading."""
    h = document_elements(spark, folder).where("level = 1")
    h = h.withColumn("n", F.row_number().over(pos.order())).withColumn("total", F.count("*").over(Window.partitionBy("document_id")))
    edge = F.when(F.col("n") == 1, "EXPOSITION").when(F.col("n") == F.col("total"), "SYNTHESIS")
    own = F.col("function_type")
    return h.select("document_id", "char_start", F.coalesce(own, edge).alias("suggested"), F.when(own.isNotNull(), 0.95).when(edge.isNotNull(), 0.6).cast("double").alias("confidence"))


@query(f"""{E}, u AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN char_start END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS unit,
  last_value(level IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS unit_level FROM e),
c AS (SELECT document_id, unit, unit_level, count(*) FILTER (WHERE element_type = 'paragraph') AS n FROM u WHERE unit IS NOT NULL GROUP BY ALL),
m AS (SELECT document_id, median(n) FILTER (WHERE unit_level = 2) AS m2, median(n) FILTER (WHERE unit_level = 3) AS m3 FROM c GROUP BY document_id)
SELECT document_id, m2::DOUBLE AS m2, m3::DOUBLE AS m3, CASE WHEN m3 BETWEEN 5 AND 15 THEN 3 WHEN m2 BETWEEN 5 AND 15 THEN 2 WHEN m3 >= 5 THEN 3 WHEN m2 >= 5 THEN 2 ELSE 1 END::INTEGER AS chosen FROM m""")
def chosen_level(spark: SparkSession, folder: str) -> DataFrame:
    """The level whose units have a fit median of paragraphs."""
    e, w = document_elements(spark, folder), pos.upto(pos.order())
    u = e.withColumn("unit", F.last(F.when(pos.is_heading(), F.struct("char_start", "level")), ignorenulls=True).over(w)).where("unit is not null")
    c = u.groupBy("document_id", "unit").agg(F.count_if(~pos.is_heading()).alias("n"))
    m = c.groupBy("document_id").agg(*[F.median(F.when(F.col("unit.level") == k, F.col("n"))).cast("double").alias(f"m{k}") for k in (2, 3)])
    fit = F.when(F.col("m3").between(5, 15), 3).when(F.col("m2").between(5, 15), 2).when(F.col("m3") >= 5, 3).when(F.col("m2") >= 5, 2).otherwise(1)
    return m.withColumn("chosen", fit.cast("int"))


@query(f"""{E}, m AS (SELECT *, CASE WHEN regexp_matches(content, '\\d{{3}}') THEN (length(content) % 100)::INTEGER END AS page FROM e)
SELECT document_id, seq, first_value(page IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS page_to FROM m""")
def page_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Elements get the page of the next marker."""
    e = document_elements(spark, folder).withColumn("page", F.when(F.col("content").rlike(r"\d{3}"), (pos.n_chars() % 100).cast("int")))
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return e.select("document_id", "seq", F.first("page", ignorenulls=True).over(w).alias("page_to"))


@query(f"""{E} SELECT e.document_id, e.seq, substring(d.text, (e.char_start + 1)::BIGINT, (e.char_end - e.char_start)::BIGINT) = e.content AS exact,
  CASE WHEN length(e.content) <= 140 THEN e.content ELSE rtrim(substring(e.content, 1, 139)) || '…' END AS snippet
FROM e JOIN documents d ON d.doc_id = e.document_id""")
def standoff_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by offsets, and snippets of at most 140 characters."""
    e = document_elements(spark, folder, keep=("text",))  # the text goes with its row, it is not joined
    span = F.substring("text", (F.col("char_start") + 1).cast("int"), pos.n_chars().cast("int"))
    snippet = F.when(pos.n_chars() <= 140, F.col("content")).otherwise(F.concat(F.rtrim(F.substring("content", 1, 139)), F.lit("…")))
    return e.select("document_id", "seq", (span == F.col("content")).alias("exact"), snippet.alias("snippet"))


_KINDS = ", ".join(f"('{x}')" for x in FUNCTION_TYPES if x)


@query(f"""{E}, t(function_type) AS (VALUES {_KINDS}),
k AS (SELECT DISTINCT document_id, function_type FROM e WHERE function_type IS NOT NULL), d AS (SELECT DISTINCT document_id FROM e)
SELECT d.document_id, string_agg(t.function_type, ',' ORDER BY t.function_type) AS missing FROM d JOIN t ON true ANTI JOIN k USING (document_id, function_type) GROUP BY d.document_id""")
def missing_types(spark: SparkSession, folder: str) -> DataFrame:
    """Required types that a document has no heading of."""
    e = document_elements(spark, folder)
    have = e.groupBy("document_id").agg(F.collect_set("function_type").alias("have"))
    need = F.array(*[F.lit(x) for x in FUNCTION_TYPES if x])
    miss = F.array_join(F.array_sort(F.array_except(need, F.col("have"))), ",")
    return have.select("document_id", miss.alias("missing")).where("missing <> ''")


@query(f"""{E}, h AS (SELECT document_id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS label, char_start FROM e WHERE element_type = 'heading'),
a AS (SELECT document_id, char_start AS anchor_id, label, char_start + CASE WHEN char_start % 2 = 0 THEN 0 ELSE 150 END AS anchor_start FROM h)
SELECT a.document_id, a.anchor_id, a.anchor_start, (SELECT arg_min(h.char_start, ((h.char_start <> a.anchor_start)::INT, h.char_start)) FROM h
  WHERE h.document_id = a.document_id AND h.label = a.label AND abs(h.char_start - a.anchor_start) <= 200) AS bound_start FROM a""")
def reanchored_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings whose anchors moved, bound again within a tolerance."""
    h = document_elements(spark, folder).where(pos.is_heading()).select("document_id", F.lower(F.trim(F.regexp_replace("content", r"\s+", " "))).alias("label"), "char_start")
    moved = F.col("char_start") + F.when(F.col("char_start") % 2 == 0, 0).otherwise(150)
    return pos.reanchor(h.select("document_id", F.col("char_start").alias("anchor_id"), "label", moved.alias("anchor_start")), h)


_MARKS = "(?i)(^|[ (])(frage|question|the|que|el)([ ,.)]|$)"
_MARK = f"regexp_matches(content, '{_MARKS}')"


@query(f"""{E}, p AS (SELECT document_id, char_start, {_MARK} AS mark, row_number() OVER ({W}) AS n FROM ({P})),
c AS (SELECT *, n - row_number() OVER (PARTITION BY document_id, mark ORDER BY char_start) AS g FROM p),
i AS (SELECT document_id, g, min(n) AS first_n, max(n) AS last_n FROM c WHERE mark GROUP BY document_id, g),
b AS (SELECT document_id, max(last_n) AS last_n, arg_max(first_n, last_n) AS first_n FROM i GROUP BY document_id)
SELECT p.document_id, p.char_start, CASE WHEN p.n < b.first_n THEN 'motivation' WHEN p.n <= b.last_n THEN 'question' ELSE 'rest' END AS part FROM p JOIN b USING (document_id)""")
def last_marker_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """The last run of marked paragraphs, what stands before it and after."""
    p = document_elements(spark, folder).where("element_type = 'paragraph'")
    p = p.withColumn("mark", F.col("content").rlike(_MARKS)).withColumn("n", F.row_number().over(pos.order()))
    r = pos.runs(p, "document_id", "char_start", F.col("mark"))
    last = r.where("mark").groupBy("document_id", "run").agg(F.min("n").alias("a"), F.max("n").alias("b")).groupBy("document_id").agg(F.max(F.struct("b", "a")).alias("l"))
    part = F.when(F.col("n") < F.col("l.a"), "motivation").when(F.col("n") <= F.col("l.b"), "question").otherwise("rest")
    return p.join(last, "document_id").select("document_id", "char_start", part.alias("part"))


@query(f"""{E}, x AS (SELECT document_id, char_start, element_type, function_type IS NOT NULL AS typed FROM e),
f AS (SELECT document_id, min(char_start) FILTER (WHERE typed) AS first_typed FROM x GROUP BY document_id)
SELECT document_id, count(*) FILTER (WHERE element_type = 'paragraph') AS n_all, count(*) FILTER (WHERE element_type = 'paragraph' AND char_start > first_typed) AS n_after FROM x JOIN f USING (document_id) GROUP BY document_id""")
def counts_after_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs in all and after the first typed heading."""
    e = document_elements(spark, folder)
    seen = F.max(F.col("function_type").isNotNull()).over(pos.upto(pos.order()))
    para = ~pos.is_heading()
    return e.withColumn("seen", seen).groupBy("document_id").agg(F.count_if(para).alias("n_all"), F.count_if(para & F.col("seen")).alias("n_after"))


@query(f"""{E}, c AS (SELECT *, max(CASE WHEN level = 1 THEN char_start END) OVER (PARTITION BY document_id) AS last_start FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY char_start DESC) AS back, count(*) OVER (PARTITION BY document_id) AS n FROM c WHERE element_type = 'paragraph' AND char_start >= last_start)
SELECT document_id, last_start, char_start, back <= greatest(1, ceil(n / 3.0)) AS in_last_third FROM p""")
def last_chapter(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of the last chapter, and which are of its last third."""
    w = Window.partitionBy("document_id")
    c = document_elements(spark, folder).drop("content").withColumn("last_start", F.max(F.when(F.col("level") == 1, F.col("char_start"))).over(w))
    p = c.where("element_type = 'paragraph' and char_start >= last_start")
    back, n = F.row_number().over(w.orderBy(F.desc("char_start"))), F.count("*").over(w)
    return p.select("document_id", "last_start", "char_start", (back <= F.greatest(F.lit(1), F.ceil(n / 3))).alias("in_last_third"))


@query(f"""{E}, x AS (SELECT *, sum((element_type = 'heading')::INT) OVER ({W}) AS block, sum((element_type = 'paragraph')::INT) OVER ({W}) AS n,
  last_value(CASE WHEN element_type = 'heading' THEN char_start END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS heading_start, last_value(function_type IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS container_type FROM e)
SELECT x.document_id, x.char_start, x.n::BIGINT AS paragraph_number, x.block::BIGINT AS block, (row_number() OVER (PARTITION BY x.document_id, x.block ORDER BY x.char_start))::BIGINT AS number_in_block, x.heading_start, x.container_type,
  l.quality, CASE WHEN length(content) <= 140 THEN content ELSE rtrim(substring(content, 1, 139)) || '…' END AS snippet
FROM x LEFT JOIN labels l ON l.doc_id = x.document_id WHERE element_type = 'paragraph'""")
def reader_payload(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader of documents is shown of each paragraph: its numbers, its
    heading and container, the document's assessment, and a snippet."""
    w = pos.upto(pos.order())
    snippet = F.when(pos.n_chars() <= 140, F.col("content")).otherwise(F.concat(F.rtrim(F.substring("content", 1, 139)), F.lit("…")))
    e = pos.blocks(document_elements(spark, folder).withColumn("snippet", snippet).drop("content"))  # at most 140 characters go through the windows
    e = e.withColumn("paragraph_number", F.sum((~pos.is_heading()).cast("long")).over(w)).withColumn("heading_start", F.last(F.when(pos.is_heading(), F.col("char_start")), ignorenulls=True).over(w))
    e = e.withColumn("container_type", F.last("function_type", ignorenulls=True).over(w)).where(~pos.is_heading())
    e = e.withColumn("number_in_block", F.row_number().over(Window.partitionBy("document_id", "block").orderBy("char_start")).cast("long"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    return e.join(labels, "document_id", "left").select("document_id", "char_start", "paragraph_number", "block", "number_in_block", "heading_start", "container_type", "quality", "snippet")
