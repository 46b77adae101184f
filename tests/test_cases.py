"""Operators over small tables made here, for what no test table holds: formats,
personal data, citations, answers of models, outlines of any depth.  The rows that
come out are stated, worked out by hand."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import citations, markers, privacy, prose, text
from quillspark.operators import graph, positions, review
from quillspark.sources import docx, formats

CASES: dict[str, tuple[Callable, list[str], list[tuple]]] = {}


def case(columns: str, *rows: tuple) -> Callable:
    """State that a function returns ``rows`` of ``columns`` (names and types)."""

    def note(f: Callable) -> Callable:
        CASES[f.__name__] = f, [c.split()[0] for c in columns.split(", ")], list(rows)
        return f

    return note


# outlines ---------------------------------------------------------------------------


def _outline(spark: SparkSession) -> DataFrame:
    rows = [("d", 20 * k, 20 * k + 10, "heading", level, out) for k, (level, out) in enumerate([(1, False), (2, False), (2, True), (2, False), (4, False), (5, False), (4, False), (1, False), (3, False), (2, False)])]
    return spark.createDataFrame([*rows, ("d", 200, 260, "paragraph", None, False), ("e", 0, 5, "heading", 3, False)], "document_id string, char_start long, char_end long, element_type string, level int, excluded boolean")


@case(
    "document_id VARCHAR, char_start BIGINT, numbering VARCHAR",
    ("d", 0, "1"), ("d", 20, "1.1"), ("d", 40, None), ("d", 60, "1.2"), ("d", 80, "1.2.0.1"), ("d", 100, "1.2.0.1.1"), ("d", 120, "1.2.0.2"), ("d", 140, "2"), ("d", 160, "2.0.1"), ("d", 180, "2.1"), ("e", 0, "0.0.1"),
)
def case_numbering(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers to any depth; an excluded heading has none and counts for nothing."""
    return positions.numbering(_outline(spark)).select("document_id", "char_start", "numbering")


@case(
    "document_id VARCHAR, char_start BIGINT, unit_end BIGINT",
    ("d", 0, 140), ("d", 20, 40), ("d", 40, 60), ("d", 60, 140), ("d", 80, 120), ("d", 100, 120), ("d", 120, 140), ("d", 140, 260), ("d", 160, 180), ("d", 180, 260), ("e", 0, 5),
)
def case_unit_ends(spark: SparkSession, folder: str) -> DataFrame:
    return positions.unit_ends(_outline(spark)).select("document_id", "char_start", F.col("unit_end").cast("long").alias("unit_end"))


# texts --------------------------------------------------------------------------------


@case("name VARCHAR, mime VARCHAR, text VARCHAR", ("a.txt", "text/plain", "Größe"), ("b.HTML", "text/html", "A&B\n\nC"), ("c.md", "text/markdown", ""), ("d", "application/octet-stream", ""))
def case_text_reads(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.createDataFrame([("a.txt", bytearray("Größe".encode())), ("b.HTML", bytearray(b"<script>x</script><p>A&amp;B</p><div>C</div>")), ("c.md", bytearray(b"# x")), ("d", bytearray(b"x"))], "name string, content binary")
    return files.withColumn("mime", text.mime_type("name")).select("name", "mime", text.read_text(F.col("content"), F.col("mime")).alias("text"))


@case(
    "id INTEGER, n INTEGER, sentence VARCHAR, char_start INTEGER, char_end INTEGER",
    (1, 0, "Vgl. Müller (S. 3).", 0, 19), (1, 1, "H. Meier sagt z.B. nichts.", 20, 46), (1, 2, "Das Kapitel?", 47, 59), (1, 3, "„Ja!“ Ende", 60, 70), (2, 0, "A. B. Cohn kam.", 1, 16), (2, 1, "1999 war gut…", 17, 30), (2, 2, "Ja.", 32, 35),
)
def case_german_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(1, "Vgl. Müller (S. 3). H. Meier sagt z.B. nichts. Das Kapitel? „Ja!“ Ende"), (2, " A. B. Cohn kam. 1999 war gut…  Ja."), (3, ""), (4, None)]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.posexplode(text.german_sentences("t")).alias("n", "s")).select("id", "n", F.col("s.text").alias("sentence"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


@case("n INTEGER, sentence VARCHAR, char_start INTEGER, char_end INTEGER", (0, "One.", 0, 4), (1, "Two! three?", 5, 16), (2, "Four", 17, 21))
def case_plain_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([("One. Two! three? Four",)], "t string").select(F.posexplode(text.sentences("t")).alias("n", "s")).select("n", F.col("s.text").alias("sentence"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


@case(
    "raw VARCHAR, label VARCHAR, stem VARCHAR, quotes VARCHAR, name VARCHAR",
    ("  Größe \n & Maß ", "größe & maß", "groesse-mass", "  Größe \n & Maß ", "Dokument_2026-05-02_Groesse.docx"),
    ("„Die“ ‚Bildungsphilosophie‘ als Reflexion", "„die“ ‚bildungsphilosophie‘ als reflexion", "die-bildungsphilosophie-als-reflexion", "\"Die\" 'Bildungsphilosophie' als Reflexion", "Dokument_2026-05-02_Bildungsphilosophie.docx"),
    ("Einleitung in das, was bleibt", "einleitung in das, was bleibt", "einleitung-in-das-was-bleibt", "Einleitung in das, was bleibt", "Dokument_2026-05-02_bleibt.docx"),
    ("", "", "", "", "Dokument_2026-05-02_anonym.docx"),
)
def case_normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Labels, file names and quotation marks."""
    rows = ["  Größe \n & Maß ", "„Die“ ‚Bildungsphilosophie‘ als Reflexion", "Einleitung in das, was bleibt", ""]
    name = text.synthetic_name(F.lit("Dokument"), F.lit("2026-05-02").cast("date"), F.col("raw"), F.lit(".docx"))
    return spark.createDataFrame([(x,) for x in rows], "raw string").select("raw", text.heading_label("raw").alias("label"), text.file_stem("raw").alias("stem"), text.straight_quotes("raw").alias("quotes"), name.alias("name"))


_NOTES = "Zusammenfassung der Anmerkungen in x.pdf\n1.2 Kapitel\nHervorheben [Seite 3]: quoted\nmore\n\n12\nNotiz [Seite 4]: \nmy note\nUnterstreichen [Seite 5]: u\n\nSchluss\nText [Seite 6]: t"


@case(
    "kind VARCHAR, content VARCHAR, page INTEGER, level INTEGER, chapter VARCHAR, semantic VARCHAR, paired_with INTEGER, char_start BIGINT, char_end BIGINT",
    ("heading", "1.2 Kapitel", None, 2, None, None, None, 0, 11), ("annotation", "quoted\nmore", 3, None, "1.2 Kapitel", "citing", None, 12, 23), ("annotation", "my note", 4, None, "1.2 Kapitel", "commenting", 1, 24, 31),
    ("annotation", "u", 5, None, "1.2 Kapitel", "citing", None, 32, 33), ("heading", "Schluss", None, 1, None, None, None, 34, 41), ("annotation", "t", 6, None, "Schluss", "commenting", 3, 42, 43),
)
def case_annotations(spark: SparkSession, folder: str) -> DataFrame:
    a = formats.annotations(spark.createDataFrame([("d", _NOTES)], "doc_id string, text string"))
    return a.select("kind", "content", "page", "level", "chapter", "semantic", "paired_with", "char_start", "char_end")


# markers --------------------------------------------------------------------------------


@case(
    "heading VARCHAR, level INTEGER, type VARCHAR, confidence DOUBLE, granularity VARCHAR",
    ("Exkurs: Methode", 1, "EXKURS", 0.95, "KAPITEL"), ("EINFÜHRUNG", 1, "EXPOSITION", 0.9, "KAPITEL"), ("2 Durchführung", 4, "DURCHFUEHRUNG", 0.7, "ABSCHNITT"), ("Theoretischer Rahmen", 2, "GRUNDLAGENTHEORIE", 0.85, "UNTERKAPITEL"),
    ("Methodik", 3, "FORSCHUNGSDESIGN", 0.7, "KAPITEL"), ("Sonstiges", 1, None, None, None),
)
def case_heading_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = [("Exkurs: Methode", 1), ("EINFÜHRUNG", 1), ("2 Durchführung", 4), ("Theoretischer Rahmen", 2), ("Methodik", 3), ("Sonstiges", 1)]
    h = spark.createDataFrame(rows, "heading string, level int").withColumn("t", markers.heading_type(F.col("heading")))
    return h.select("heading", "level", "t.type", "t.confidence", markers.granularity(F.col("t.type"), F.col("level")).alias("granularity"))


_MARKED = [
    ("c", 1, "Es zeigt sich im Material ein Befund. Die Arbeit gliedert sich, zunächst so."), ("c", 2, "Wie LÄSST SICH ERKENNEN, was gilt?"), ("c", 3, "Nichts davon."),
    ("c", 4, "Im ersten Kapitel geht es um die Fallstudie, im Folgenden um Interviews."), ("x", 1, "Darauf aufbauend: die Forschungsfrage."),
]


@case(
    "container VARCHAR, n INTEGER, findings VARCHAR, question BOOLEAN, method BOOLEAN, is_plan BOOLEAN",
    ("c", 1, "zeigt_sich,befund_lemma,material_referenz", False, False, True), ("c", 2, "lassen_sich", True, False, False), ("c", 3, "", False, False, False), ("c", 4, "", False, True, True), ("x", 1, "", True, False, False),
)
def case_markers(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("content")
    names = F.array_join(F.transform(markers.findings(c), lambda h: h["name"]), ",")
    return spark.createDataFrame(_MARKED, "container string, n int, content string").select("container", "n", names.alias("findings"), markers.is_question(c).alias("question"), markers.is_method(c).alias("method"), markers.plan(c)["is_plan"].alias("is_plan"))


@case("container VARCHAR, n INTEGER, n_markers INTEGER, ratio DOUBLE", ("c", 1, 3, 0.5), ("c", 2, 1, 0.5))
def case_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return markers.hotspots(spark.createDataFrame(_MARKED, "container string, n int, content string")).select("container", "n", "n_markers", "ratio")


# citations --------------------------------------------------------------------------------

_CITING = "Klafki (2007) und von Saldern et al. (2012a, S. 3) zeigen (vgl. Bohnsack, 2010; Cramer & Drahmann 2019), Anfang 2022 (Jahr 2022)."


@case("id INTEGER, n INTEGER", (1, 2), (2, 0), (3, 1))
def case_inline_citations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(1, "A (Klein 2012) und (Groß, vgl. 2013)."), (2, "(klein 2012), Klein (2012)"), (3, "(Ölmann 1999; Klein 2000)")], "id int, t string").select("id", citations.n_inline("t").alias("n"))


@case(
    "at INTEGER, raw VARCHAR, authors VARCHAR, year VARCHAR, suffix VARCHAR, page VARCHAR",
    (0, "Klafki (2007)", "Klafki", "2007", None, None), (18, "von Saldern et al. (2012a, S. 3)", "von Saldern", "2012", "a", "3"),
    (64, "Bohnsack, 2010", "Bohnsack", "2010", None, None), (80, "Cramer & Drahmann 2019", "Cramer+Drahmann", "2019", None, None),
)
def case_citations(spark: SparkSession, folder: str) -> DataFrame:
    c = spark.createDataFrame([(_CITING,), ("",), (None,)], "t string").select(F.explode(citations.citations_of("t")).alias("c")).select("c.*")
    return c.select(F.col("offset").alias("at"), "raw", F.array_join("authors", "+").alias("authors"), "year", "suffix", "page")


@case("id INTEGER, entries VARCHAR", (1, "1"), (2, "1,2"), (3, "1,2"), (4, ""))
def case_resolved_citations(spark: SparkSession, folder: str) -> DataFrame:
    """The entry of a suffix, else all of that author and year."""
    bib = spark.createDataFrame([("1", "d", "Klein, P. (2012a). X."), ("2", "d", "Klein, P. (2012b). Y."), ("3", "d", "Ohne Jahr")], "entry_id string, document_id string, raw_text string")
    cited = spark.createDataFrame([(1, "d", "Klein", "2012", "a"), (2, "d", "Klein", "2012", "c"), (3, "d", "Klein", "2012", None), (4, "d", "Groß", "2012", None)], "citation_id int, document_id string, author string, year string, suffix string")
    return citations.resolve(cited, citations.bibliography_keys(bib)).select(F.col("citation_id").alias("id"), F.array_join("entry_ids", ",").alias("entries"))


@case("document_id VARCHAR, char_start BIGINT, content VARCHAR", ("a", 30, "Klein 2012."), ("b", 20, "Groß 2013."), ("b", 40, "Weit 2014."))
def case_bibliographies(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by the kind of section, else below the heading that says so."""
    rows = [
        ("a", 0, "heading", "main", "Literatur"), ("a", 10, "paragraph", "main", "No entry."), ("a", 20, "heading", "bibliography", "Quellen"), ("a", 30, "paragraph", "bibliography", " Klein 2012. "), ("a", 50, "paragraph", "bibliography", "x"),
        ("b", 0, "paragraph", "main", "Text."), ("b", 10, "heading", "main", " Literatur und Quellen "), ("b", 20, "paragraph", "main", "Groß 2013."), ("b", 40, "paragraph", "main", "Weit 2014."), ("b", 60, "heading", "main", "Literatur"), ("b", 70, "paragraph", "main", "Not this one."),
    ]
    e = spark.createDataFrame(rows, "document_id string, char_start long, element_type string, section_kind string, content string")
    return citations.bibliography_paragraphs(e)


# personal data --------------------------------------------------------------------------------

_PERSONAL = "Anna Muster schreibt. Muster (anna.muster@x.org)"


def _seeded(spark: SparkSession) -> DataFrame:
    seeds = [("person_name", privacy.name_variants("Anna Muster"), "[NAME_001]"), ("email", ["anna.muster@x.org"], "[EMAIL_001]")]
    return spark.createDataFrame([("d", _PERSONAL, seeds), ("e", "nothing", [])], "document_id string, text string, seeds array<struct<category:string,variants:array<string>,replacement:string>>")


@case("category VARCHAR, value VARCHAR, replacement VARCHAR", ("email", "ab@c.de", "[EMAIL_001]"), ("student_id", "21925501", "[STUDENT_ID_001]"), ("phone", "0911 123456", "[PHONE_001]"), ("phone", "+49 911 1234567", "[PHONE_002]"))
def case_contact_seeds(spark: SparkSession, folder: str) -> DataFrame:
    c = [("d", "Matrikelnummer: 219 255-01 mail 12ab@c.de, AB@c.de ab@c.de Tel: 0911 123456 und +49 911 1234567, Fax: 12.03.2024"), ("e", None)]
    return privacy.contact_seeds(spark.createDataFrame(c, "doc_id string, text string")).select("category", "value", "replacement")


@case("n INTEGER, variant VARCHAR", (0, "Prof. Dr. Anna Muster"), (1, "Muster, Anna"), (2, "Anna Muster"), (3, "A. Muster"), (4, "Muster"))
def case_name_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(privacy.name_variants("Prof. Dr. Anna Muster"),)], "v array<string>").select(F.posexplode("v").alias("n", "variant"))


@case("document_id VARCHAR, text VARCHAR, n_name BIGINT, n_email BIGINT", ("d", "[NAME_001] schreibt. [NAME_001] ([EMAIL_001])", 2, 1), ("e", "nothing", 0, 0))
def case_redactions(spark: SparkSession, folder: str) -> DataFrame:
    """Longer variants first, none over another; edits by category."""
    e = _seeded(spark).withColumn("edits", privacy.edits("text", "seeds"))
    n = lambda k: F.size(F.filter("edits", lambda x: x["category"] == k)).cast("long")
    return e.select("document_id", privacy.redacted(F.col("text"), F.col("edits")).alias("text"), n("person_name").alias("n_name"), n("email").alias("n_email"))


@case("char_start INTEGER, new_start INTEGER, new_end INTEGER", (0, 0, 20), (22, 21, 45))
def case_moved_offsets(spark: SparkSession, folder: str) -> DataFrame:
    e = _seeded(spark).where("document_id = 'd'").withColumn("edits", privacy.edits("text", "seeds"))
    e = e.select("edits", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(21).alias("b")), F.struct(F.lit(22).alias("a"), F.lit(48).alias("b")))).alias("s"))
    return e.select(F.col("s.a").alias("char_start"), privacy.moved(F.col("s.a"), F.col("s.b"), F.col("edits")).alias("m")).select("char_start", F.col("m.start").alias("new_start"), F.col("m.end").alias("new_end"))


@case("document_id VARCHAR, text VARCHAR, n_edits INTEGER, outline_status VARCHAR", ("d", "[NAME_001] schreibt. [NAME_001] ([EMAIL_001])", 3, "confirmed"), ("e", "nothing", 0, None))
def case_redacted_again(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.redact_again(_seeded(spark), spark.createDataFrame([("d", "confirmed")], "document_id string, outline_status string"))


@case("document_id VARCHAR, seed_id VARCHAR, candidate VARCHAR, start INTEGER, context VARCHAR", ("d", "s", "muster", 5, "Anna Muster schr"), ("d", "w", "ann", 28, " Ihr Ann komm"))
def case_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The first candidate of each seed; one of three characters needs word edges."""
    texts = spark.createDataFrame([("d", "Anna Muster schreib er. Ihr Ann kommt"), ("e", "nothing")], "document_id string, text string")
    seeds = spark.createDataFrame([("d", "s", ["zz", "muster", "Anna"]), ("d", "w", ["ann"]), ("e", "s", ["no one"])], "document_id string, seed_id string, variants array<string>")
    return privacy.leaks(texts, seeds, 5)


@case(
    "id INTEGER, author VARCHAR, state VARCHAR",
    (1, "redacted", "skipped_already_redacted"), (2, "name_present", "applied"), (3, "no_author_label", "no_candidates"), (4, "redacted", "skipped_already_redacted"), (5, "name_present", "no_candidates"), (6, "redacted", "skipped_already_redacted"),
)
def redaction_states(spark: SparkSession, folder: str) -> DataFrame:
    """What is to be done with documents, by what stands for their author."""
    rows = [
        (1, "Vorgelegt von:\n ████\nmail a@b.de"), (2, "Autorin: Anna Muster\nmail a@b.de"), (3, "Ein Text ohne alles."), (4, "vorgelegt von Dr. phil. [ANONYMISIERT]"),
        (5, "Submitted by Max Groß\n████"), (6, "Name: xxxxx\nTel: 0911 123456"),
    ]
    d = spark.createDataFrame(rows, "id int, text string")
    return d.select("id", privacy.author_state(F.col("text")).alias("author"), privacy.redaction_state(F.col("text"), privacy.contact_seeds_of("text")).alias("state"))


_FRONT = "Betreuerin: Prof. Dr. Eva Klein\nvorgelegt von Max Groß\nDoktorvater: Ed Alt" + " " * 200 + "Lea Kurz"


@case("person VARCHAR, role VARCHAR", ("Eva Klein", "supervisor"), ("Max Groß", "author"), ("Ed Alt", "supervisor"), ("Lea Kurz", "other"), ("Ida Neu", "author"), ("Tom Weit", "other"))
def case_roles(spark: SparkSession, folder: str) -> DataFrame:
    labels = privacy.role_labels(spark.createDataFrame([("d", _FRONT)], "document_id string, text string"))
    persons = spark.createDataFrame([("d", n, _FRONT.index(n)) for n in ("Eva Klein", "Max Groß", "Ed Alt", "Lea Kurz")] + [("e", "Ida Neu", 5), ("e", "Tom Weit", 90)], "document_id string, text string, start int")
    return privacy.person_roles(persons, labels).select(F.col("text").alias("person"), "role")


@case("person VARCHAR, char_start INTEGER", ("Eva Klein", 10), ("Max Groß", 30))
def case_split_persons(spark: SparkSession, folder: str) -> DataFrame:
    two = spark.createDataFrame([("d", "Eva Klein Prof. Dr. Max Groß", 10), ("d", "Single", 0)], "document_id string, text string, start int")
    return privacy.split_persons(two).select(F.col("text").alias("person"), F.col("start").cast("int").alias("char_start"))


@case("id INTEGER, title VARCHAR", (1, "Ein langer Titel"), (2, "A longer name of a work"), (3, None))
def case_title_hints(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.createDataFrame([(1, "Titel: Ein langer Titel\nx", ["a"]), (2, "nothing", ["short", "A longer name of a work"]), (3, "nothing", [])], "id int, t string, names array<string>")
    return d.select("id", privacy.title_hint(F.col("t"), F.col("names")).alias("title"))


# answers of models and graphs --------------------------------------------------------------------

_GRAPH = """intro
ARGUMENT A1
claim: one
 goes on
premises:
- stated: p1
- carried §2: p2
- odd
anchor: one
grounding: concrete
ARGUMENT A2
claim: two
ARGUMENT A3
claim: three
ARGUMENT A4
claim:
EDGES
A1 -refines-> §0:A2
A2 -supports-> A1
A3 -presupposes-> A1, A2
A1 -contradicts-> §1:A1
SCAFFOLDING S1
excerpt: "q"
function: didaktisch
description: d
assessment: a
anchored_to: A1, §1:A1; §1:A9, what"""


def _answers(spark: SparkSession) -> dict[str, DataFrame]:
    return prose.argument_graph(spark.createDataFrame([("r", _GRAPH), ("e", "")], "atom_id string, raw_text string"))


@case("local_id VARCHAR, claim VARCHAR, anchor_phrase VARCHAR, grounding VARCHAR", ("A1", "one\n goes on", "one", "concrete"), ("A2", "two", "", "none"), ("A3", "three", "", "none"))
def case_arguments(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark)["arguments"].drop("atom_id")


@case("local_id VARCHAR, n INTEGER, type VARCHAR, text VARCHAR, from_paragraph INTEGER", ("A1", 0, "stated", "p1", None), ("A1", 1, "carried", "p2", 2), ("A1", 2, "stated", "odd", None))
def case_premises(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark)["premises"].drop("atom_id")


@case(
    "from_id VARCHAR, to_id VARCHAR, kind VARCHAR, scope VARCHAR",
    ("A2", "A1", "supports", "inter_argument"), ("A3", "A1", "supports", "inter_argument"), ("A3", "A2", "supports", "inter_argument"), ("A1", "§1:A1", "contradicts", "prior_paragraph"),
)
def case_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark)["edges"].drop("atom_id")


@case("local_id VARCHAR, excerpt VARCHAR, function_type VARCHAR, anchored VARCHAR", ("S1", "q", "didaktisch", "A1 §1:A1 §1:A9"))
def case_scaffolding(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark)["scaffolding"].select("local_id", "excerpt", "function_type", F.array_join("anchored_to", " ").alias("anchored"))


@case("what VARCHAR, n BIGINT", ("no claim", 1), ("no paragraph 0", 1), ("presupposes made supports", 2))
def case_graph_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark)["warnings"].groupBy("what").agg(F.count("*").alias("n"))


def _stored(spark: SparkSession) -> dict[str, DataFrame]:
    """The graph above as that of paragraph 2, after a paragraph with one argument."""
    first = prose.argument_graph(spark.createDataFrame([("q", "ARGUMENT A1\nclaim: zero")], "atom_id string, raw_text string"))
    tables = {k: v.unionByName(first[k]) for k, v in _answers(spark).items()}
    paragraphs = spark.createDataFrame([("q", "u", 1, "Text zero.", 0), ("r", "u", 2, "And one more.", 20), ("e", "u", 3, "Nothing.", 50)], "atom_id string, unit string, position int, text string, char_start long")
    return graph.stored_graph(tables, paragraphs)


@case("node_id VARCHAR, anchor_start BIGINT, anchor_end BIGINT", ("u/1/A1", 0, 10), ("u/2/A1", 24, 27), ("u/2/A2", 20, 33), ("u/2/A3", 20, 33))
def case_stored_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark)["nodes"].select("node_id", F.col("anchor_start").cast("long").alias("anchor_start"), F.col("anchor_end").cast("long").alias("anchor_end"))


@case("from_node VARCHAR, to_node VARCHAR, kind VARCHAR", ("u/2/A2", "u/2/A1", "supports"), ("u/2/A3", "u/2/A1", "supports"), ("u/2/A3", "u/2/A2", "supports"), ("u/2/A1", "u/1/A1", "contradicts"))
def case_stored_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark)["edges"].select("from_node", "to_node", "kind")


@case("scaffold VARCHAR, node_id VARCHAR", ("S1", "u/2/A1"), ("S1", "u/1/A1"))
def case_stored_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark)["anchors"].select("scaffold", "node_id")


@case("atom_id VARCHAR, at VARCHAR, reason VARCHAR", ("r", "§1:A9", "no such argument"), ("e", None, "nothing found"))
def case_store_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark)["errors"]


@case("ref VARCHAR, node_id VARCHAR, reason VARCHAR", ("A1", "n1", None), ("§2:A1", "n2", None), ("?", None, "unreadable"), ("A9", None, "no such argument"), ("§0:A1", None, "no such paragraph"))
def case_references(spark: SparkSession, folder: str) -> DataFrame:
    refs = spark.createDataFrame([("u", 3, x) for x in ("A1", "§2:A1", "?", "A9", "§0:A1")], "unit string, position int, ref string")
    nodes = spark.createDataFrame([("u", 3, "A1", "n1"), ("u", 2, "A1", "n2")], "unit string, position int, local_id string, node_id string")
    return graph.resolve_references(refs, nodes).select("ref", "node_id", "reason")


@case("local_id VARCHAR, label VARCHAR", ("A1", "A1"), ("A2", "§7:A2"), ("A3", "A3"))
def case_anchor_labels(spark: SparkSession, folder: str) -> DataFrame:
    return graph.anchor_labels(spark.createDataFrame([("u", 3, "A1", 3), ("u", 3, "A2", 7), ("u", 3, "A3", None)], "unit string, position int, local_id string, at int")).select("local_id", "label")


@case("phrase VARCHAR, anchor_start BIGINT, anchor_end BIGINT", ("def", 104, 107), ("zz", 100, 107), ("", 100, 107))
def case_anchor_spans(spark: SparkSession, folder: str) -> DataFrame:
    n = spark.createDataFrame([("abc def", 100, x) for x in ("def", "zz", "")], "text string, char_start long, phrase string")
    return graph.anchor_spans(n).select("phrase", F.col("anchor_start").cast("long").alias("anchor_start"), F.col("anchor_end").cast("long").alias("anchor_end"))


_PROSE = "# SUMMARY\nfirst\nsecond\n## POINT 3\ntext: three\nnote:\n a\n b\n### Other\nlost\n## POINT 1\ntext: one"


@case(
    "part VARCHAR, name VARCHAR, n INTEGER, key VARCHAR, value VARCHAR",
    ("value", "SUMMARY", None, None, "first\nsecond"), ("item", "POINT", 3, "text", "three"), ("item", "POINT", 3, "note", "a\n b"), ("item", "POINT", 1, "text", "one"), ("failure", "header-scan", None, None, "x"),
)
def case_structured_prose(spark: SparkSession, folder: str) -> DataFrame:
    one, items, bad = prose.structured(spark.createDataFrame([("r", _PROSE), ("x", "nothing")], "atom_id string, raw_text string"), ["SUMMARY"], {"POINT": ["text", "note"]})
    none = lambda t: F.lit(None).cast(t)
    out = one.select(F.lit("value").alias("part"), "name", none("int").alias("n"), none("string").alias("key"), "value")
    out = out.unionByName(items.select(F.lit("item").alias("part"), "name", "n", "key", "value"))
    return out.unionByName(bad.select(F.lit("failure").alias("part"), F.col("stage").alias("name"), none("int").alias("n"), none("string").alias("key"), F.col("atom_id").alias("value")))


@case("id INTEGER, a INTEGER", (1, 1), (2, 2), (3, None), (4, None))
def case_json_answers(spark: SparkSession, folder: str) -> DataFrame:
    j = spark.createDataFrame([(1, 'say {"a": 1} now'), (2, "{„a“: 2}"), (3, "none"), (4, "{broken")], "id int, t string")
    return j.select("id", prose.json_object(F.col("t"), "a int")["a"].alias("a"))


@case("local_id VARCHAR, carries BOOLEAN, form VARCHAR, fallacy VARCHAR, target VARCHAR, rationale VARCHAR", ("A1", True, "inductive", None, None, "r\n more"), ("A2", False, None, "circular", "p1", "x"))
def case_validity(spark: SparkSession, folder: str) -> DataFrame:
    raw = "## VALIDITY A1\ncarries: yes\nform: inductive\nrationale: r\n more\n**VALIDITY A2**\ncarries: no\nfallacy: circular\ntarget: p1\nrationale: x\nVALIDITY A3\ncarries: no\nfallacy: unknown\ntarget: p\nrationale: y\nVALIDITY A9\ncarries: yes\nform: deductive\nrationale: z"
    known = spark.createDataFrame([("r", f"A{k}") for k in (1, 2, 3)], "atom_id string, local_id string")
    return prose.validity(spark.createDataFrame([("r", raw)], "atom_id string, raw_text string"), known, ["circular"]).select("local_id", "carries", "form", "fallacy", "target", "rationale")


@case("rank INTEGER, node_id VARCHAR, rationale VARCHAR", (2, "n2", "a"))
def case_answers_by_rank(spark: SparkSession, folder: str) -> DataFrame:
    answers = spark.createDataFrame([("u", "Nr. 2", " a "), ("u", "0", "b"), ("u", "x", "c"), ("u", "9", "d")], "unit string, number string, rationale string")
    return review.by_rank(answers, spark.createDataFrame([("u", 1, "n1"), ("u", 2, "n2")], "unit string, rank int, node_id string")).select("rank", "node_id", "rationale")


@case("section VARCHAR, histogram VARCHAR", ("s", "carried:1 stated:2"), ("t", "background:1"))
def case_premise_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return review.premise_histogram(spark.createDataFrame([("s", "stated"), ("s", "stated"), ("s", "carried"), ("t", "background")], "section string, type string"), ["section"])


@case("k VARCHAR, block VARCHAR", ("k", "## A\nx\n\n## B\ny"))
def case_format_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return review.format_blocks(spark.createDataFrame([("k", 2, "B", "y"), ("k", 1, "A", "x")], "k string, o int, t string, b string"), "k", "t", "b", "o")


@case("module VARCHAR, provider VARCHAR, retries INTEGER, success BOOLEAN, tokens VARCHAR, message_length INTEGER", ("m", "p", 1, True, '{"input":10,"output":2,"cacheRead":0}', None), ("n", "unknown", 0, False, '{"input":5,"output":0,"cacheRead":1}', 2000))
def case_call_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = [("m", "k", "p", 1, True, 10, 2, 0, None), ("n", "k", None, None, None, 5, 0, 1, "x" * 3000), (None, "k", "p", 0, True, 1, 1, 1, None)]
    calls = spark.createDataFrame(rows, "module string, model_key string, provider string, retries int, success boolean, input long, output long, cache_read long, error_message string")
    return review.call_log(calls).select("module", "provider", "retries", "success", "tokens", F.length("error_message").alias("message_length"))


@case("run VARCHAR, step INTEGER, message VARCHAR", ("r", 1, "done graph (1/3)"), ("r", 2, "failed section (2/3)"))
def case_progress(spark: SparkSession, folder: str) -> DataFrame:
    steps = spark.createDataFrame([("r", 1, "graph"), ("r", 2, "section"), ("r", 3, "chapter")], "run string, step int, kind string")
    return review.progress(steps, spark.createDataFrame([("r", 1, True), ("r", 2, False)], "run string, step int, ok boolean"))


@case("id INTEGER, markers VARCHAR, n INTEGER", (1, "a+b", 2), (2, "", 0), (3, None, -1))
def case_sub_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """An array of strings from a part of a JSON value."""
    j = spark.createDataFrame([(1, '{"marker_names": ["a", "b"]}'), (2, '{"marker_names": []}'), (3, "{}")], "id int, t string")
    names = F.from_json("t", "marker_names array<string>")["marker_names"]
    return j.select("id", F.array_join(names, "+").alias("markers"), F.coalesce(F.size(names), F.lit(-1)).alias("n"))


# files --------------------------------------------------------------------------------------------


def _files(spark: SparkSession) -> DataFrame:
    """A DOCX file with headings, notes, drawings and a table of contents; one that is none; and a null one."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, more="": f"<w:r>{more}<w:t>{t}</w:t></w:r>"
    para = lambda t, s="", more="", front="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr>{front}{run(t) if t else ""}{more}</w:p>'
    box = lambda t: f"<w:r><w:drawing><w:txbxContent><w:p>{run(t)}</w:p></w:txbxContent></w:drawing></w:r>"
    picture = "<w:r><w:drawing><w:x/></w:drawing></w:r>"
    toc = lambda t, s, a: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:hyperlink w:anchor="{a}">{run(t)}</w:hyperlink></w:p>'
    mark = lambda a: f'<w:bookmarkStart w:name="{a}"/>'
    body = (
        para("Titel") + toc("1 Einleitung .... 3", "T1", "b1") + toc("1.1 Unter 4", "T2", "b2") + para("1 Einleitung", "H1", front=mark("b1")) + para("Ein Satz, der") + para("weitergeht.", more='<w:r><w:footnoteReference w:id="2"/></w:r>')
        + para(" Erster Satz.", more=run("1", '<w:rPr><w:vertAlign w:val="superscript"/></w:rPr>') + run(" Zweiter Satz") + run("2", '<w:rPr><w:rStyle w:val="Note"/></w:rPr>') + run(" geht weiter.") + box("Die erste Note") + box("17"))
        + para("1.2 Unter", "Sub", front=mark("b2")) + para("Abb. 1: Ein Bild", more=picture + box("Zweite Note") + picture) + para("Ohne Bild", "Caption") + para("Literatur", "H1") + para("Klein 2012") + para("Groß 2013.")
    )
    style = lambda key, name, more="": f'<w:style w:styleId="{key}"><w:name w:val="{name}"/>{more}</w:style>'
    styles = style("H1", "heading 1") + style("H2", "Überschrift 2") + style("Sub", "own", '<w:basedOn w:val="H2"/>') + style("T1", "toc 1") + style("T2", "Verzeichnis 2")
    styles += style("Up", "up", '<w:rPr><w:vertAlign w:val="superscript"/></w:rPr>') + style("Note", "note", '<w:basedOn w:val="Up"/>') + style("R1", "r", '<w:basedOn w:val="R2"/>') + style("R2", "r", '<w:basedOn w:val="R1"/>')
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:id="2"><w:p>{run("Note")}</w:p></w:footnote></w:footnotes>')
    return spark.createDataFrame([("d", bytearray(buffer.getvalue())), ("bad", bytearray(b"no zip")), ("none", None)], "document_id string, content binary")


def _paragraphs(spark: SparkSession) -> DataFrame:
    return docx.paragraphs(_files(spark))


@case(
    "seq BIGINT, element_type VARCHAR, content VARCHAR, level INTEGER, section_kind VARCHAR, position_role VARCHAR, char_start BIGINT",
    (1, "paragraph", "Titel", None, "front_matter", "before_heading", 0), (2, "toc_entry", "1 Einleitung .... 3", None, "front_matter", "before_heading", 6), (3, "toc_entry", "1.1 Unter 4", None, "front_matter", "before_heading", 26),
    (4, "heading", "1 Einleitung", 1, "main", None, 38), (5, "paragraph", "Ein Satz, der weitergeht.", None, "main", "before_heading", 51), (6, "paragraph", "Erster Satz.1 Zweiter Satz2 geht weiter.", None, "main", "before_heading", 77),
    (7, "heading", "1.2 Unter", 2, "main", None, 118), (8, "caption", "Abb. 1: Ein Bild", None, "main", "before_heading", 128), (9, "caption", "Ohne Bild", None, "main", "before_heading", 145),
    (10, "heading", "Literatur", 1, "bibliography", None, 155), (11, "paragraph", "Klein 2012", None, "bibliography", "after_heading", 165), (12, "paragraph", "Groß 2013.", None, "bibliography", "mid", 176),
)
def case_docx_elements(spark: SparkSession, folder: str) -> DataFrame:
    return docx.document_elements(_paragraphs(spark)).select("seq", "element_type", "content", "level", "section_kind", "position_role", "char_start")


@case("document_id VARCHAR, error BOOLEAN", ("bad", True), ("none", True))
def case_docx_failures(spark: SparkSession, folder: str) -> DataFrame:
    """A file that can't be read fails alone."""
    return _paragraphs(spark).where("error is not null").select("document_id", (F.col("error") != "").alias("error"))


@case("document_id VARCHAR, front VARCHAR", ("d", "Titel\n\n1 Einleitung"), ("bad", "[DOCX text extraction fai"), ("none", "[DOCX text extraction fai"))
def case_docx_texts(spark: SparkSession, folder: str) -> DataFrame:
    t = docx.flat_text(_files(spark))
    return t.select("document_id", F.when(F.col("document_id") == "d", F.substring("text", 1, 19)).otherwise(F.substring("text", 1, 25)).alias("front"))


@case("marker VARCHAR, sentence VARCHAR, note VARCHAR", ("1", "Erster Satz.1 Zweiter Satz2 geht weiter.", "Die erste Note"), ("2", "Erster Satz.1 Zweiter Satz2 geht weiter.", "Zweite Note"))
def case_docx_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Raised numbers, also by a style's style, with their sentences and notes."""
    return docx.note_bindings(_paragraphs(spark)).select("marker", "sentence", "note")


@case("idx INTEGER, pos INTEGER, kind VARCHAR, content VARCHAR", (6, 0, "footnote", "Die erste Note"), (6, 1, "page_marker", "17"), (8, 0, "figure", None), (8, 1, "footnote", "Zweite Note"), (8, 2, "figure", None))
def case_docx_drawings(spark: SparkSession, folder: str) -> DataFrame:
    return docx.drawings(_paragraphs(spark)).select("idx", "pos", "kind", "content")


@case("idx INTEGER, figure INTEGER", (8, 2), (9, None))
def case_docx_captions(spark: SparkSession, folder: str) -> DataFrame:
    return docx.captions(_paragraphs(spark)).select("idx", "figure")


@case("title VARCHAR, level INTEGER, heading_idx INTEGER, mismatch BOOLEAN", ("1 Einleitung", 1, 3, False), ("1.1 Unter", 2, 7, True))
def case_docx_contents(spark: SparkSession, folder: str) -> DataFrame:
    return docx.toc_references(_paragraphs(spark)).select("title", "level", "heading_idx", "mismatch")


@case("idx INTEGER, note_text VARCHAR", (5, "Note"))
def case_docx_footnotes(spark: SparkSession, folder: str) -> DataFrame:
    return docx.footnotes(_paragraphs(spark)).select("idx", "note_text")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    f, columns, rows = CASES[name]
    df = f(spark, "")
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(rows, key=repr)
