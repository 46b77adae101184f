"""Queries that read texts: formats, contact data, redaction, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markers, privacy, text
from quillspark.registry import query
from quillspark.sources import export, formats
from quillspark.sources.tables import ELEMENTS_SQL, document_elements, table


def _chain() -> str:
    out = "html"
    for pattern, new in text.HTML_REWRITES:
        lit = lambda x: "'" + x.replace("'", "''") + "'"
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(new)}, 'g')" if new != "\n" and new != "\n\n" else f"regexp_replace({out}, {lit(pattern)}, repeat(chr(10), {len(new)}), 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {_chain()} AS text FROM pages")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as text by rewrites."""
    return table(spark, folder, "pages").select("page_id", text.html_to_text("html").alias("text"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.MIME.items())


@query(f"SELECT page_id, CASE list_last(string_split(lower(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1)), '.')) {_CASES} ELSE 'application/octet-stream' END AS mime FROM pages")
def page_types(spark: SparkSession, folder: str) -> DataFrame:
    name = F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1)
    return table(spark, folder, "pages").select("page_id", text.mime_type(name).alias("mime"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: regexp_replace(x, '^\d+([A-Za-z])', '\1')))), ' ') AS emails
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')""")
def document_emails(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(F.col("text").contains("@"))
    return d.select("doc_id", F.array_join(F.array_sort(privacy.emails("text")), " ").alias("emails")).where("emails <> ''")


@query(r"""SELECT doc_id, length(text)::BIGINT AS n_chars, list_sum(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: (trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')::INT))::BIGINT AS n_paragraphs FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def text_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    n = formats.paragraphs(d).groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_paragraphs"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(n, "doc_id")


@query(f"""WITH {ELEMENTS_SQL} SELECT document_id, string_agg(CASE WHEN element_type = 'heading' THEN repeat('#', level) || ' ' || content ELSE content END, chr(10) || chr(10) ORDER BY char_start) AS markdown FROM e GROUP BY document_id""")
def exported_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return export.markdown(document_elements(spark, folder))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rewritten(value: str, pattern: str, new: str, times: int = 1) -> str:
    for _ in range(times):  # what a look-around sees is taken here, so that hits side by side need another turn
        value = f"regexp_replace({value}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return value


_HELD = _rewritten("content", rf"(?i)(^|[^A-Za-z0-9_])({'|'.join(text.ABBREVIATIONS)})\.", r"\1\2" + text._MARK, 2)
_HELD = _rewritten(_HELD, "(^|[^A-Za-z0-9_])([A-ZÄÖÜ])\\.([\\s\u00a0]?[A-ZÄÖÜ-])", r"\1\2" + text._MARK + r"\3", 3)
_CUT = _rewritten(_HELD, "([.?!…][)\\]\"'»”]*)(\\s+[\"'»„“A-ZÄÖÜ0-9])", r"\1" + text._CUT + r"\2", 2)


@query(f"""WITH a AS (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS c, list_append(regexp_extract_all(text, '\\n\\s*\\n'), '') AS g FROM documents),
b AS (SELECT doc_id, unnest(c) AS content, unnest(g) AS gap, unnest(range(len(c))) AS paragraph FROM a),
p AS (SELECT *, coalesce(sum(length(content) + length(gap)) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM b),
s AS (SELECT doc_id, paragraph, base, string_split({_CUT}, '{text._CUT}') AS parts FROM p WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) <> ''),
u AS (SELECT doc_id, paragraph, base, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM s),
o AS (SELECT *, base + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, paragraph ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(part) - length(regexp_replace(part, '^\\s+', '')) AS place,
      replace(regexp_replace(part, '^\\s+|\\s+$', '', 'g'), '{text._MARK}', '.') AS content FROM u)
SELECT doc_id AS document_id, paragraph::INTEGER AS paragraph, (row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY k) - 1)::INTEGER AS n, content, place::BIGINT AS char_start, (place + length(content))::BIGINT AS char_end FROM o WHERE content <> ''""")
def sentence_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with their places in the document."""
    return formats.sentence_elements(formats.paragraphs(table(spark, folder, "documents")))


@query()
def redacted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with contact data replaced, and how many places of each kind."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    seeds = F.transform(privacy.contact_seeds_of("text"), lambda s: F.struct(s["category"].alias("category"), F.array(s["value"]).alias("variants"), s["replacement"].alias("replacement")))
    e = d.withColumn("seeds", seeds).withColumn("edits", F.when(F.size("seeds") > 0, privacy.edits("text", "seeds")))
    e = e.withColumn("edits", F.coalesce("edits", F.array().cast(privacy.EDITS)))
    n = lambda k: F.size(F.filter("edits", lambda x: x.category == k)).alias(f"n_{k}")
    return e.select("document_id", privacy.redacted(F.col("text"), F.col("edits")).alias("text"), n("email"), n("phone"), n("student_id"))


def _hits(patterns) -> str:
    return " OR ".join(f"regexp_matches(content, {_quoted(p.replace('(?iu)', '(?i)'))})" for p in patterns)


_IN_SEQUENCE = " + ".join(f"{n} * regexp_matches(content, {_quoted(p.replace('(?iu)', '(?i)'))})::INT" for p, n in markers.SEQUENCE)
_FOUND = " + ".join(f"regexp_matches(content, {_quoted(p.replace('(?iu)', '(?i)'))})::INT" for _, p in markers.FINDINGS)


@query(f"""WITH {ELEMENTS_SQL}, m AS (SELECT document_id, char_start, ({_FOUND})::INTEGER AS n_findings, {_hits(markers.QUESTIONS)} AS question, {_hits(markers.METHODS)} AS method,
  ({_IN_SEQUENCE}) AS hits, ({_hits(markers.STRUCTURE)}) AS built FROM e WHERE element_type = 'paragraph'),
p AS (SELECT *, hits >= 3 OR (built AND hits >= 1) AS is_plan FROM m)
SELECT document_id, char_start, n_findings, question, method, is_plan FROM p WHERE n_findings > 0 OR question OR method OR is_plan""")
def marked_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs with markers of findings, questions, methods or plans."""
    p = document_elements(spark, folder).where("element_type = 'paragraph'")
    c = F.col("content")
    out = p.select("document_id", "char_start", markers.findings(c).alias("findings"), markers.is_question(c).alias("question"), markers.is_method(c).alias("method"), markers.plan(c).alias("plan"))
    return out.where("size(findings) > 0 or question or method or plan.is_plan").select("document_id", "char_start", F.size("findings").alias("n_findings"), "question", "method", "plan.is_plan")


_RULES = " ".join(f"WHEN regexp_matches(content, {_quoted('(?i)' + p)}) THEN {{'type': '{kind}', 'granularity': '{markers.GRANULARITY[kind]}', 'confidence': {confidence}::DOUBLE}}" for p, kind, confidence in markers.HEADING_RULES)


@query(f"""WITH {ELEMENTS_SQL}, h AS (SELECT document_id, char_start, CASE {_RULES} END AS t FROM e WHERE element_type = 'heading')
SELECT document_id, char_start, t.type AS type, t.granularity AS granularity, t.confidence AS confidence FROM h""")
def typed_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings with the type that their words name."""
    h = document_elements(spark, folder).where("element_type = 'heading'")
    return h.select("document_id", "char_start", markers.heading_type(F.col("content")).alias("t")).select("document_id", "char_start", "t.*")
