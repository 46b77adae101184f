"""Citations, markers, personal data and files read from texts that Spark writes
from the tables; SQL states what they hold from the tables directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import citations, markers, privacy, text
from quillspark.plans.answers import I, _items, _orders, _text
from quillspark.registry import query
from quillspark.sources import docx, export, formats
from quillspark.sources.folders import written
from quillspark.sources.tables import ELEMENTS_SQL, document_elements, lines, table

#: Parts as persons: the words of their names, and two years.
N = """p AS (SELECT p_partkey AS id, p_brand AS doc, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] AS first, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS last, (1990 + p_size % 30)::VARCHAR AS y, (1980 + p_partkey % 40)::VARCHAR AS z FROM part)"""


def _persons(spark: SparkSession, folder: str) -> DataFrame:
    word = lambda k: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(k)))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), word(1).alias("first"), word(2).alias("last"), (1990 + F.col("p_size") % 30).cast("string").alias("y"), (1980 + F.col("p_partkey") % 40).cast("string").alias("z"))




# citations


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    first, last, y, z = (F.col(c) for c in ("first", "last", "y", "z"))
    said = _text(last, " (", y, ") und ", first, " ", last, " et al. (", z, "a, S. 3) zeigen (vgl. ", last, ", ", y, "; ", first, " & ", last, " ", z, "), Anfang 2022 (Jahr 2022).")
    # the table is small and its texts are much work: it is dealt out by id, so that mentions are counted where they are read
    dealt = _persons(spark, folder).repartition(2 * spark.sparkContext.defaultParallelism, "id")
    return dealt.withColumn("text", said)


@query(f"""WITH {N}, c AS (SELECT *, length(last) + 12 AS a, length(last) + 12 + length(first) + 1 + length(last) + 30 AS b FROM p)
SELECT id, 0 AS "at", last || ' (' || y || ')' AS raw, last AS authors, y AS year, NULL AS suffix, NULL AS page FROM c
UNION ALL SELECT id, a, first || ' ' || last || ' et al. (' || z || 'a, S. 3)', first || ' ' || last, z, 'a', '3' FROM c UNION ALL SELECT id, b + 5, last || ', ' || y, last, y, NULL, NULL FROM c
UNION ALL SELECT id, b + 5 + length(last) + 8, first || ' & ' || last || ' ' || z, first || '+' || last, z, NULL, NULL FROM c""")
def inline_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations in running text and in brackets, with their places; words that
    are no authors cite nothing."""
    c = _cited(spark, folder).select("id", F.explode(citations.citations_of("text")).alias("c")).select("id", "c.*")
    return c.select("id", F.col("offset").alias("at"), "raw", F.array_join("authors", "+").alias("authors"), "year", "suffix", "page")


@query(f"""WITH {N} SELECT id, 1 AS n FROM p""")
def counted_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Brackets that begin with a name and have a year."""
    first, last, y = F.col("first"), F.col("last"), F.col("y")
    return _persons(spark, folder).select("id", citations.n_inline(_text("Wie (", last, " ", y, ") und (", F.lower(first), " ", y, ") sagen, ", last, " (", y, ").")).alias("n"))


@query(f"""WITH {N}, c AS (SELECT id, doc, 0 AS char_start, unnest([{{a: last, y: y, s: NULL}}, {{a: first || ' ' || last, y: z, s: 'a'}}, {{a: last, y: y, s: NULL}}, {{a: first, y: z, s: NULL}}, {{a: last, y: z, s: NULL}}]) AS m FROM p)
SELECT id, m.a AS author, m.y AS year, m.s AS suffix, count(*) AS n FROM c GROUP BY ALL""")
def cited_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of authors in paragraphs."""
    return citations.mentions(_cited(spark, folder).select("id", "text")).groupBy("id", "author", "year", "suffix").agg(F.count("*").alias("n"))


@query(f"""WITH {N}, e AS (SELECT id, doc, last, y, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS s FROM p WHERE id % 5 <> 0), c AS (SELECT id, doc, last, y, CASE id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'a' END AS s FROM p),
m AS (SELECT c.id, e.id AS entry, coalesce(c.s = e.s, false) AS exact FROM c JOIN e USING (doc, last, y)), b AS (SELECT id, list(entry ORDER BY entry::VARCHAR) FILTER (WHERE exact) AS same, list(entry ORDER BY entry::VARCHAR) AS any_ FROM m GROUP BY id)
SELECT c.id, coalesce(array_to_string(CASE WHEN len(same) > 0 THEN same ELSE any_ END, ','), '') AS entries FROM c LEFT JOIN b USING (id)""")
def resolved_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations with the entries of their document: those of the same suffix,
    else all of that author and year."""
    p, k = _persons(spark, folder), F.col("id")
    suffix = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("")
    entry = _text(F.col("last"), ", ", F.substring("first", 1, 1), ". (", F.col("y"), suffix, "). A title.")
    bib = citations.bibliography_keys(p.where("id % 5 <> 0").select(k.cast("string").alias("entry_id"), F.col("doc").alias("document_id"), entry.alias("raw_text")))
    cited = p.select(k.alias("citation_id"), F.col("doc").alias("document_id"), F.col("last").alias("author"), F.col("y").alias("year"), F.when(k % 4 == 0, "c").when(k % 4 == 1, "a").alias("suffix"))
    return citations.resolve(cited, bib).select(F.col("citation_id").alias("id"), F.array_join("entry_ids", ",").alias("entries"))


@query(f"""WITH {I}, e AS (SELECT o AS document_id, n * 10 AS char_start, n IN (2, 5) AS head, CASE WHEN o % 3 = 0 AND n > 5 THEN 'bibliography' ELSE 'main' END AS k, CASE n WHEN 2 THEN CASE WHEN o % 2 = 0 THEN 'Literatur und Quellen' ELSE 'Method' END WHEN 5 THEN 'Quellen' ELSE CASE WHEN p % 4 = 0 THEN ' x ' ELSE ' entry ' || p || ' ' END END AS content FROM i),
b AS (SELECT document_id FROM e WHERE k = 'bibliography' AND NOT head), f AS (SELECT document_id, min(char_start) AS a FROM e WHERE head AND k = 'main' AND content <> 'Method' GROUP BY document_id),
x AS (SELECT e.*, f.a, coalesce((SELECT min(h.char_start) FROM e h WHERE h.document_id = e.document_id AND h.head AND h.char_start > f.a), 1000) AS z FROM e LEFT JOIN f USING (document_id))
SELECT document_id, char_start::BIGINT AS char_start, trim(content) AS content FROM x WHERE NOT head AND length(trim(content)) >= 5 AND CASE WHEN document_id IN (SELECT document_id FROM b) THEN k = 'bibliography' ELSE char_start > a AND char_start < z END""")
def bibliographies(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by the kind of their section, else below the heading that says so."""
    o, n = F.col("o"), F.col("n")
    words = F.when(n == 2, F.when(o % 2 == 0, "Literatur und Quellen").otherwise("Method")).when(n == 5, "Quellen").otherwise(F.when(F.col("p") % 4 == 0, " x ").otherwise(_text(" entry ", F.col("p"), " ")))
    e = _items(spark, folder).select(o.alias("document_id"), (n * 10).cast("long").alias("char_start"), F.when(n.isin(2, 5), "heading").otherwise("paragraph").alias("element_type"), F.when((o % 3 == 0) & (n > 5), "bibliography").otherwise("main").alias("section_kind"), words.alias("content"))
    return citations.bibliography_paragraphs(e)


# markers

_HEADINGS = (("Exkurs: Methode", "EXKURS", 0.95, "KAPITEL"), ("EINFÜHRUNG", "EXPOSITION", 0.9, "KAPITEL"), ("2 Durchführung", "DURCHFUEHRUNG", 0.7, "UNTERKAPITEL"), ("Theoretischer Rahmen", "GRUNDLAGENTHEORIE", 0.85, "UNTERKAPITEL"), ("Methodik", "FORSCHUNGSDESIGN", 0.7, "KAPITEL"), ("Sonstiges", None, None, None))
_MARKED = (
    ("Es zeigt sich im Material ein Befund. Die Arbeit gliedert sich, zunächst so.", "zeigt_sich,befund_lemma,material_referenz", False, False, True), ("Wie LÄSST SICH ERKENNEN, was gilt?", "lassen_sich", True, False, False), ("Nichts davon.", "", False, False, False),
    ("Im ersten Kapitel geht es um die Fallstudie, im Folgenden um Interviews.", "", False, True, True), ("Darauf aufbauend: die Forschungsfrage.", "", True, False, False),
)


def _pick(k: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _in_sql(k: str, values: list) -> str:
    quoted = ["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, float) else "'" + v + "'" for v in values]
    return f"(CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END)"


_H = list(zip(*_HEADINGS, strict=True))
_M = list(zip(*_MARKED, strict=True))


@query(f"""WITH {I} SELECT o, n, {_in_sql('p', _H[1])} AS type, {_in_sql('p', _H[2])}::DOUBLE AS confidence, CASE WHEN n > 3 AND {_in_sql('p', _H[3])} IS NOT NULL THEN 'ABSCHNITT' ELSE {_in_sql('p', _H[3])} END AS granularity FROM i""")
def worded_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Types that headings name, and how much of a work they stand for by their level."""
    h = _items(spark, folder).select("o", "n", _text(_pick(F.col("p"), _H[0]), " ").alias("heading")).withColumn("t", markers.heading_type(F.col("heading")))
    return h.select("o", "n", "t.type", "t.confidence", markers.granularity(F.col("t.type"), F.col("n")).alias("granularity"))


@query(f"""WITH {I} SELECT o, n, {_in_sql('p', _M[1])} AS findings, {_in_sql('p', _M[2])} AS question, {_in_sql('p', _M[3])} AS method, {_in_sql('p', _M[4])} AS is_plan FROM i""")
def marked_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of findings, questions, methods and plans."""
    c = F.col("content")
    p = _items(spark, folder).select("o", "n", _text(_pick(F.col("p"), _M[0]), " Nr. ", F.col("p"), ".").alias("content"))
    return p.select("o", "n", F.array_join(F.transform(markers.findings(c), lambda h: h["name"]), ",").alias("findings"), markers.is_question(c).alias("question"), markers.is_method(c).alias("method"), markers.plan(c)["is_plan"].alias("is_plan"))


@query(f"""WITH {I}, m AS (SELECT o, n, {_in_sql('p', [3.0, 1.0, 0.0, 0.0, 0.0])}::INTEGER AS k FROM i) SELECT o, n, k AS n_markers, (SELECT count(*) FILTER (WHERE k > 0) / count(*) FROM m x WHERE x.o = m.o)::DOUBLE AS ratio FROM m WHERE k > 0""")
def hotspots(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs with markers of findings, and their share in the container."""
    p = _items(spark, folder).select("o", "n", _pick(F.col("p"), _M[0]).alias("content"))
    return markers.hotspots(p, container="o")


# names and sentences


@query(f"""WITH {ELEMENTS_SQL} SELECT document_id, seq, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS label, regexp_replace(regexp_replace(replace(replace(replace(replace(lower(content), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS stem,
  regexp_replace(regexp_replace('„' || content || '“ ‚x’', '[„“”«»]', '"', 'g'), '[‚‘’]', '''', 'g') AS quotes FROM e""")
def normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as labels, as names of files, and with plain quotation marks."""
    e = document_elements(spark, folder)
    return e.select("document_id", "seq", text.heading_label("content").alias("label"), text.file_stem("content").alias("stem"), text.straight_quotes(_text("„", F.col("content"), "“ ‚x’")).alias("quotes"))


@query(f"""WITH {N} SELECT id, 'Dokument_2026-05-02_' || CASE WHEN length(first) >= 4 THEN first WHEN length(last) >= 4 THEN last ELSE 'anonym' END || '.docx' AS name FROM p""")
def synthetic_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of files that tell one word of a title."""
    title = _text("Prof. Dr. Die ", F.col("first"), " und die ", F.col("last"))
    return _persons(spark, folder).select("id", text.synthetic_name(F.lit("Dokument"), F.lit("2026-05-02").cast("date"), title, F.lit(".docx")).alias("name"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.?!][)\\]"''»”]*)(\\s+)([A-ZÄÖÜ])', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM s), t AS (SELECT doc_id, k, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS content FROM u)
SELECT doc_id, count(*) AS n, sum(length(content))::BIGINT AS n_chars, max(length(content))::BIGINT AS longest FROM t WHERE content <> '' GROUP BY doc_id""")
def plain_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences by their ends alone, counted and measured."""
    s = table(spark, folder, "documents").select("doc_id", F.explode(text.sentences("text")).alias("s"))
    size = F.length("s.text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(size).alias("n_chars"), F.max(size).cast("long").alias("longest"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '' ELSE '' END AS text FROM documents")
def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the bytes of files, read by their types: plain text, and
    kinds without a reader."""
    k = F.col("doc_id") % 4
    name = F.when(k <= 1, "a.TXT").when(k == 2, "b.md").otherwise("c")
    return table(spark, folder, "documents").select("doc_id", text.read_text(F.encode("text", "UTF-8"), text.mime_type(name)).alias("text"))


# annotation summaries


@query(f"""WITH {I}, x AS (SELECT o, n, (o % 9 + 1) || '.' || n || ' Kap ' || n AS h, 'q' || p || chr(10) || 'more' AS q, 'c' || s AS c FROM i),
r AS (SELECT o, n, 0 AS k, 'heading' AS kind, h AS content, NULL::INTEGER AS page, 2 AS level, NULL AS chapter, NULL AS semantic FROM x UNION ALL SELECT o, n, 1, 'annotation', q, n, NULL, h, 'citing' FROM x UNION ALL SELECT o, n, 2, 'annotation', c, n, NULL, h, 'commenting' FROM x),
y AS (SELECT *, row_number() OVER w - 1 AS idx, coalesce(sum(length(content) + 1) OVER (PARTITION BY o ORDER BY n, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM r WINDOW w AS (PARTITION BY o ORDER BY n, k))
SELECT o AS document_id, kind, content, page::INTEGER AS page, level, chapter, semantic, CASE WHEN k = 2 THEN idx - 1 END::INTEGER AS paired_with, char_start, (char_start + length(content))::BIGINT AS char_end FROM y""")
def annotation_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of annotations read back: chapters, entries over several lines,
    comments with the entry they follow, and places in the joined text."""
    o = F.substring("atom_id", 2, 20).cast("long")
    part = lambda x: _text(F.col("o") % 9 + 1, ".", x.n, " Kap ", x.n, "\nHervorheben [Seite ", x.n, "]: q", x.p, "\nmore\n\nNotiz [Seite ", x.n, "]: \nc", x.s, "\n\n12\n")
    whole = _orders(spark, folder).select(o.alias("o"), "items").select(F.col("o").alias("doc_id"), _text("Zusammenfassung der Anmerkungen in x.pdf\n", F.array_join(F.transform("items", part), "")).alias("text"))
    a = formats.annotations(whole)
    return a.select("document_id", "kind", "content", "page", "level", "chapter", "semantic", "paired_with", "char_start", "char_end")


# personal data


@query("""SELECT c_custkey AS document_id, unnest(['email', 'student_id', 'phone']) AS category, unnest(['ab' || c_custkey || '@x.org', (10000000 + c_custkey)::VARCHAR, '0911 ' || (100000 + c_custkey)]) AS value, unnest(['[EMAIL_001]', '[STUDENT_ID_001]', '[PHONE_001]']) AS replacement FROM customer""")
def contact_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Contact data of texts: digits run together with an address go, equal
    values count once, dates are no numbers."""
    k = F.col("c_custkey")
    said = _text("Matrikelnummer: ", k + 10_000_000, " mail 12ab", k, "@x.org, AB", k, "@X.org Tel: 0911 ", k + 100_000, " und Fax: 12.03.2024")
    return privacy.contact_seeds(table(spark, folder, "customer").select(k.alias("doc_id"), said.alias("text")))


@query(f"""WITH {N} SELECT id, unnest(range(5))::INTEGER AS n, unnest(['Prof. Dr. ' || first || ' ' || last, last || ', ' || first, first || ' ' || last, first[1] || '. ' || last, last]) AS variant FROM p""")
def person_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of persons' names, the longest first."""
    name = _text("Prof. Dr. ", F.col("first"), " ", F.col("last"))
    return _persons(spark, folder).select("id", F.posexplode(privacy.variants_of(name)).alias("n", "variant"))


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, text, seeds): a name in two forms, and an address made of it."""
    first, last = F.col("first"), F.col("last")
    mail = _text(F.lower(first), ".", F.lower(last), "@x.org")
    seeds = F.array(F.struct(F.lit("person_name").alias("category"), F.col("v").alias("variants"), F.lit("[NAME_001]").alias("replacement")), F.struct(F.lit("email").alias("category"), F.array(mail).alias("variants"), F.lit("[EMAIL_001]").alias("replacement")))
    p = _persons(spark, folder).withColumn("v", privacy.variants_of(_text(first, " ", last)))
    return p.select(F.col("id").alias("document_id"), _text(first, " ", last, " schreibt. ", last, " (", mail, ") Nr. ", F.col("id")).alias("text"), F.when(F.col("id") % 4 == 3, F.array_compact(F.slice(seeds, 3, 1))).otherwise(seeds).alias("seeds"), "first", "last")


_LETTER = "first || ' ' || last || ' schreibt. ' || last || ' (' || lower(first) || '.' || lower(last) || '@x.org) Nr. ' || id"


@query(f"""WITH {N} SELECT id AS document_id, CASE WHEN id % 4 = 3 THEN {_LETTER} ELSE '[NAME_001] schreibt. [NAME_001] ([EMAIL_001]) Nr. ' || id END AS text, CASE WHEN id % 4 = 3 THEN 0 ELSE 2 END::BIGINT AS n_name, CASE WHEN id % 4 = 3 THEN 0 ELSE 1 END::BIGINT AS n_email FROM p""")
def redacted_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Longer variants first, none over another; edits by category."""
    e = _letters(spark, folder).withColumn("edits", privacy.edits("text", "seeds"))
    n = lambda k: F.size(F.filter("edits", lambda x: x["category"] == k)).cast("long")
    return e.select("document_id", privacy.redacted(F.col("text"), F.col("edits")).alias("text"), n("person_name").alias("n_name"), n("email").alias("n_email"))


@query(f"""WITH {N}, s AS (SELECT *, length(first || ' ' || last || ' schreibt.') AS a, length({_LETTER}) AS whole FROM p)
SELECT id AS document_id, unnest([0, a + 1])::INTEGER AS char_start, unnest(CASE WHEN id % 4 = 3 THEN [0, a + 1] ELSE [0, 21] END)::INTEGER AS new_start, unnest(CASE WHEN id % 4 = 3 THEN [a, whole] ELSE [20, length('[NAME_001] schreibt. [NAME_001] ([EMAIL_001]) Nr. ' || id)] END)::INTEGER AS new_end FROM s""")
def moved_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Where elements stand after the edits."""
    e = _letters(spark, folder).withColumn("edits", privacy.edits("text", "seeds"))
    end = F.length(_text(F.col("first"), " ", F.col("last"), " schreibt."))
    e = e.select("document_id", "edits", F.explode(F.array(F.struct(F.lit(0).alias("a"), end.alias("b")), F.struct((end + 1).alias("a"), F.length("text").alias("b")))).alias("s"))
    return e.select("document_id", F.col("s.a").alias("char_start"), privacy.moved(F.col("s.a"), F.col("s.b"), F.col("edits")).alias("m")).select("document_id", "char_start", F.col("m.start").alias("new_start"), F.col("m.end").alias("new_end"))


@query(f"""WITH {N} SELECT id AS document_id, CASE WHEN id % 4 = 3 THEN {_LETTER} ELSE '[NAME_001] schreibt. [NAME_001] ([EMAIL_001]) Nr. ' || id END AS text, CASE WHEN id % 4 = 3 THEN 0 ELSE 3 END AS n_edits, CASE WHEN id % 2 = 0 THEN 'confirmed' END AS outline_status FROM p""")
def redacted_again(spark: SparkSession, folder: str) -> DataFrame:
    """Letters redacted anew from their originals; what a user confirmed stays."""
    done = _persons(spark, folder).where("id % 2 = 0").select(F.col("id").alias("document_id"), F.lit("confirmed").alias("outline_status"))
    return privacy.redact_again(_letters(spark, folder).select("document_id", "text", "seeds"), done)


@query(f"""WITH {N} SELECT id AS document_id, 'v' AS seed_id, last AS candidate, length(first) + 1 AS start, substring({_LETTER}, greatest(1, length(first) + 2 - 5), length(last) + CASE WHEN length(first) + 1 < 5 THEN 10 ELSE 10 END) AS context FROM p""")
def leaked_names(spark: SparkSession, folder: str) -> DataFrame:
    """The first candidate of each seed that a text still holds."""
    p = _letters(spark, folder)
    seeds = p.select("document_id", F.lit("v").alias("seed_id"), F.array(F.lit("nowhere in it"), F.col("last"), F.col("first")).alias("variants")).unionByName(p.select("document_id", F.lit("none").alias("seed_id"), F.array(F.lit("zz zz")).alias("variants")))
    return privacy.leaks(p.select("document_id", "text"), seeds, 5)




@query(f"""WITH {N} SELECT id, unnest(range(5))::INTEGER AS k, unnest(['supervisor', 'author', 'supervisor', 'other', CASE WHEN id % 2 = 0 THEN 'author' END]) AS role FROM p""")
def person_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles by the nearest label before a person; without any the first person
    of a document is its author."""
    first, last, k = F.col("first"), F.col("last"), F.col("id")
    p = _persons(spark, folder)
    front = _text("Betreuerin: Prof. Dr. ", first, " ", last, "\nvorgelegt von ", last, " ", first, "\nDoktorvater: ", first, " ", first)
    size = F.length("first") + F.length("last") + 1
    starts = [F.lit(22), 22 + size + 15, 22 + 2 * size + 15 + 14, F.length(front) + 200]
    labels = privacy.role_labels(p.select(k.alias("document_id"), _text(front, F.repeat(F.lit(" "), 200), first, " ", last).alias("text")))
    named = p.select(k.alias("document_id"), F.posexplode(F.array(*[x.cast("int") for x in starts])).alias("k", "start"))
    bare = p.select((-k - 1).alias("document_id"), F.lit(4).alias("k"), F.lit(5).alias("start"))  # documents without labels
    out = privacy.person_roles(named.unionByName(bare), labels)
    return out.select(F.when(F.col("k") == 4, -F.col("document_id") - 1).otherwise(F.col("document_id")).alias("id"), "k", F.when((F.col("k") == 4) & (F.col("document_id") % 2 == 0), None).otherwise(F.col("role")).alias("role"))


@query(f"""WITH {N} SELECT id, unnest([first || ' ' || last, last || ' ' || first]) AS person, unnest([10, 10 + instr(first || ' ' || last || ' Prof. Dr. ' || last || ' ' || first, last || ' ' || first) - 1])::INTEGER AS char_start FROM p""")
def split_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that run together, split before titles."""
    first, last = F.col("first"), F.col("last")
    two = _persons(spark, folder).select(F.col("id").alias("document_id"), _text(first, " ", last, " Prof. Dr. ", last, " ", first).alias("text"), F.lit(10).alias("start"))
    out = privacy.split_persons(two.unionByName(two.select("document_id", F.lit("Single").alias("text"), "start")))
    return out.select(F.col("document_id").alias("id"), F.col("text").alias("person"), F.col("start").cast("int").alias("char_start"))


@query(f"""WITH {N} SELECT id, CASE id % 3 WHEN 0 THEN 'Ein Titel von ' || last WHEN 1 THEN 'A longer name of ' || first END AS title FROM p""")
def title_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Titles by their label, else by the first name of a work."""
    k = F.col("id") % 3
    said = F.when(k == 0, _text("onderwerp: Ein Titel von ", F.col("last"), ". Und mehr\nx")).otherwise("nothing")
    names = F.when(k == 1, F.array(F.lit("short"), _text("A longer name of ", F.col("first")))).otherwise(F.array().cast("array<string>"))
    return _persons(spark, folder).select("id", privacy.title_hint(said, names).alias("title"))


_STATES = (("redacted", "skipped_already_redacted"), ("name_present", "applied"), ("no_author_label", "no_candidates"), ("redacted", "skipped_already_redacted"), ("name_present", "no_candidates"), ("redacted", "skipped_already_redacted"))


@query(f"""WITH {N} SELECT id, {_in_sql('id', [a for a, _ in _STATES])} AS author, {_in_sql('id', [b for _, b in _STATES])} AS state FROM p""")
def redaction_states(spark: SparkSession, folder: str) -> DataFrame:
    """What is to be done with documents, by what stands for their author."""
    k, name = F.col("id") % 6, _text(F.col("first"), " ", F.col("last"))
    said = F.when(k == 0, "Vorgelegt von:\n ████\nmail a@b.de").when(k == 1, _text("Autorin: ", name, "\nmail a@b.de")).when(k == 2, "Ein Text ohne alles.").when(k == 3, "vorgelegt von Dr. phil. [ANONYMISIERT]")
    said = said.when(k == 4, _text("Submitted by ", name, "\n████")).otherwise("Name: xxxxx\nTel: 0911 123456")
    d = _persons(spark, folder).select("id", said.alias("text"))
    return d.select("id", privacy.author_state(F.col("text")).alias("author"), privacy.redaction_state(F.col("text"), privacy.contact_seeds_of("text")).alias("state"))


# files


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as DOCX files, their paragraphs ended by a full stop; every
    eighth file is none."""
    e = document_elements(spark, folder).where("document_id % 8 <> 7")
    e = e.withColumn("content", F.when(F.col("element_type") == "heading", F.col("content")).otherwise(_text(F.col("content"), ".")))
    bad = table(spark, folder, "documents").where("doc_id % 8 = 7").select(F.col("doc_id").alias("document_id"), F.encode(F.lit("no zip"), "UTF-8").alias("content"))
    return export.docx(e).unionByName(bad)


def _id() -> Column:
    """Ids of files are strings."""
    return F.col("document_id").cast("long").alias("document_id")


_DOCX = f"""{ELEMENTS_SQL}, d AS (SELECT document_id, element_type, level, trim(regexp_replace(content || CASE WHEN element_type = 'paragraph' THEN '.' ELSE '' END, '[\\t\\r\\n]', ' ', 'g')) AS content, row_number() OVER (PARTITION BY document_id ORDER BY char_start) AS seq FROM e WHERE document_id % 8 <> 7 AND trim(content) <> '')"""


@query(f"""WITH {_DOCX} SELECT document_id, seq, element_type, content, level, CASE WHEN max((level = 1)::INT) OVER (PARTITION BY document_id ORDER BY seq) = 1 THEN 'main' ELSE 'front_matter' END AS section_kind,
  CASE WHEN element_type = 'paragraph' THEN CASE WHEN max((element_type = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 1 THEN 'before_heading' WHEN lag(element_type) OVER (PARTITION BY document_id ORDER BY seq) = 'heading' THEN 'after_heading' ELSE 'mid' END END AS position_role,
  coalesce(sum(length(content) + 1) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM d""")
def docx_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as DOCX files and read back as elements: types, levels
    by style, sections, roles and places."""
    e = docx.document_elements(written(docx.paragraphs(_files(spark, folder)), "paragraphs"))  # read three times
    return e.select(_id(), "seq", "element_type", "content", "level", "section_kind", "position_role", "char_start")


@query("SELECT doc_id AS document_id, 'BadZipFile' AS reason FROM documents WHERE doc_id % 8 = 7")
def docx_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Files that can't be read fail alone."""
    return docx.paragraphs(_files(spark, folder)).where("error is not null").select(_id(), F.split_part("error", F.lit(":"), F.lit(1)).alias("reason"))


@query(f"""WITH {_DOCX} SELECT document_id, string_agg(content || chr(10) || chr(10), '' ORDER BY seq) AS text FROM d GROUP BY document_id UNION ALL SELECT doc_id, '[DOCX text extraction failed]' FROM documents WHERE doc_id % 8 = 7""")
def docx_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of DOCX files, and what stands for those that can't be read."""
    return docx.flat_text(_files(spark, folder)).select(_id(), "text")
