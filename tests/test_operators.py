"""Operators on small hand-made tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import citations, markers, privacy, prose, text
from quillspark.operators import graph, positions, profile, review, state
from quillspark.sources import docx, export, formats


def elements(spark, rows):
    schema = "document_id string, char_start long, char_end long, element_type string, level int, function_type string"
    return spark.createDataFrame([("d", s, s + 10, k, lv, t) for s, k, lv, t in rows], schema)


@pytest.fixture(scope="module")
def walk(spark):
    h, p = "heading", "paragraph"
    return elements(spark, [(0, h, 1, "E"), (50, p, None, None), (100, h, 2, None), (150, p, None, None), (200, h, 1, "D"), (250, p, None, None), (300, h, 1, "S"), (350, p, None, None)])


def starts(df):
    return [r["char_start"] for r in df.orderBy("char_start").collect()]


def test_as_of_before_and_after(walk):
    assert starts(positions.nearest_heading(walk).where("heading_type = 'D'")) == [250]
    assert starts(positions.nearest_heading(walk, only="D")) == [250, 350]
    dual = {r["char_start"]: (r["direct_start"], r["container_type"]) for r in positions.dual_heading(walk).collect()}
    assert dual[150] == (100, "E")
    ends = {r["char_start"]: r["unit_end"] for r in positions.unit_ends(walk).collect()}
    assert ends == {0: 200, 100: 200, 200: 300, 300: 360}
    assert positions.next_heading(walk).orderBy("char_start").first()["next_start"] == 100


def test_numbering(spark):
    e = elements(spark, [(k * 20, "heading", lv, None) for k, lv in enumerate([1, 2, 2, 1, 3, 2])])
    got = [r["numbering"] for r in positions.numbering(e).orderBy("char_start").collect()]
    assert got == ["1", "1.1", "1.2", "2", "2.0.1", "2.1"]


def test_complexes_close_without_type(spark):
    h, p = "heading", "paragraph"
    e = elements(spark, [(0, p, None, None), (20, h, 1, "E"), (40, p, None, None), (60, p, None, None), (80, h, 2, None), (100, p, None, None)])
    got = sorted((r["heading_start"], r["n_paragraphs"]) for r in positions.complexes(e).collect())
    assert got == [(20, 2), (80, 1)]


def test_reanchor_takes_first_not_nearest(spark):
    a = spark.createDataFrame([("d", 1, "x", 260), ("d", 2, "x", 250), ("d", 3, "y", 0)], "document_id string, anchor_id long, label string, anchor_start long")
    h = spark.createDataFrame([("d", "x", s) for s in (100, 250, 420)], "document_id string, label string, char_start long")
    assert {r["anchor_id"]: r["bound_start"] for r in positions.reanchor(a, h).collect()} == {1: 100, 2: 250, 3: None}


def test_profiles(spark):
    m = spark.createDataFrame([("c", x) for x in "AAAB"], "c string, author string")
    r = profile.concentration(m, "c", "author").first()
    assert (r["hhi"], r["top1"], r["top3"], r["leading"]) == (0.625, 0.75, 1.0, "A,B")
    rows = spark.createDataFrame([("c", k, x) for k, x in enumerate("AA_AAAB")], "c string, k long, author string").withColumn("author", F.nullif("author", F.lit("_")))
    runs = profile.author_runs(rows, "c", ["k"], "author")
    assert sorted((r["first_n"], r["len"], r["author"] or "") for r in runs.collect()) == [(1, 2, "A"), (3, 1, ""), (4, 3, "A"), (7, 1, "B")]
    free = profile.stretches(runs, "c", F.coalesce(F.col("author") == "A", F.lit(False)), 1)
    assert sorted((r["first_n"], r["last_n"]) for r in free.collect()) == [(3, 3), (7, 7)]
    per = spark.createDataFrame([("p", "X", 1), ("p", "Y", 2), ("p", "Y", 3), ("p", "X", 4)], "p string, author string, at long")
    assert profile.dominant_author(per, ["p"], "author", "at").first()["dominant"] == "Y"


def test_log_folds(spark):
    log = spark.createDataFrame([("n", 1, "cue", None), ("n", 2, None, "x"), ("n", 3, "specification", None)], "id string, seq long, designation string, inscription string")
    r = state.latest(log, ["id"], ["seq"], "designation", "inscription").first()
    assert (r["designation"], r["inscription"]) == ("specification", "x")
    m = spark.createDataFrame([("a", 1, "assign"), ("a", 2, "remove"), ("a", 3, "assign"), ("b", 1, "assign"), ("b", 2, "remove")], "id string, seq long, action string")
    assert [r["id"] for r in state.members(m, ["id"], ["seq"], F.col("action") == "assign", F.col("action") == "remove").collect()] == ["a"]
    s = spark.createDataFrame([("c", 1, "origin", [], "o"), ("c", 2, "re_spec", ["a", "b"], "ab"), ("c", 3, "re_spec", ["c"], "c"), ("c", 4, "re_spec", ["b", "a"], "ba")], "k string, seq long, kind string, anchors array<string>, snap string")
    assert tuple(state.version_stack(s, "k", ["seq"], "anchors", "snap").first()) == ("c", 3, "ba")


def test_upserts_and_merges(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, user_set boolean")
    new = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "z", False)], "k int, v string, user_set boolean")
    got = {r["k"]: (r["v"], r["outcome"]) for r in state.upsert(old, new, ["k"], keep=F.col("o.user_set")).collect()}
    assert got == {1: ("a", "skipped"), 2: ("y", "updated"), 3: ("z", "created")}
    assert state.insert_missing(old, new, ["k"]).count() == 3
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a int, b int")
    merged = state.merge_entities(links, spark.createDataFrame([(3, 2)], "merged int, survivor int"), "a", "b")
    assert {tuple(r) for r in merged.collect()} == {(1, 2), (2, 4)}


def test_graph(spark):
    e = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    assert {tuple(r) for r in graph.degrees(e, "a", "b").collect()} == {("x", 2), ("y", 1), ("z", 1)}
    refs = spark.createDataFrame([("u", 3, "A1"), ("u", 3, "§2:A1"), ("u", 3, "?"), ("u", 3, "A9"), ("u", 3, "§0:A1")], "unit string, position int, ref string")
    nodes = spark.createDataFrame([("u", 3, "A1", "n1"), ("u", 2, "A1", "n2")], "unit string, position int, local_id string, node_id string")
    got = {r["ref"]: (r["node_id"], r["reason"]) for r in graph.resolve_references(refs, nodes).collect()}
    assert got == {"A1": ("n1", None), "§2:A1": ("n2", None), "?": (None, "unreadable"), "A9": (None, "no such argument"), "§0:A1": (None, "no such paragraph")}
    n = spark.createDataFrame([("abc def", 100, "def"), ("abc", 100, "zz"), ("abc", 100, "")], "text string, char_start long, phrase string")
    assert sorted((r["anchor_start"], r["anchor_end"]) for r in graph.anchor_spans(n).collect()) == [(100, 103), (100, 103), (104, 107)]
    score = spark.range(1).select(graph.candidate_score(F.lit(2), F.lit(True), F.lit(6)).alias("a"), graph.candidate_score(F.lit(1), F.lit(False), F.lit(0)).alias("b")).first()
    assert (score["a"], score["b"]) == (7, 1)


def test_text_functions(spark):
    df = spark.createDataFrame([("<script>x</script><p>A&amp;B</p><div>C</div>", "a.b.HTML"), ("", "noext")], "h string, n string")
    assert [r[0] for r in df.select(text.html_to_text("h")).collect()] == ["A&B\n\nC", ""]
    assert [r[0] for r in df.select(text.mime_type("n")).collect()] == ["text/html", "application/octet-stream"]
    assert spark.range(1).select(text.file_stem(F.lit("Größe & Maß: Über")), text.heading_label(F.lit("  A \n B ")), text.span(F.lit("abcdef"), F.lit(2), F.lit(4)), text.straight_quotes(F.lit("„a“"))).first()[:] == ("groesse-mass-ueber", "a b", "cd", '"a"')


def test_markers(spark):
    t = ["Exkurs: Methode", "Fazit und Ausblick", "Theoretischer Rahmen", "Methodik", "Sonstiges"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(markers.heading_type(F.col("t"))).collect()]
    assert [g and (g["type"], g["confidence"]) for g in got] == [("EXKURS", 0.95), ("SCHLUSSREFLEXION", 0.9), ("GRUNDLAGENTHEORIE", 0.85), ("FORSCHUNGSDESIGN", 0.7), None]
    r = spark.createDataFrame([("Es zeigt sich im Material ein Befund. Die Arbeit gliedert sich, zunächst so.",)], "t string")
    one = r.select(markers.findings(F.col("t")).alias("f"), markers.plan(F.col("t")).alias("p"), markers.is_question(F.col("t")).alias("q")).first()
    assert [x["name"] for x in one["f"]] == ["zeigt_sich", "befund_lemma", "material_referenz"] and one["p"]["is_plan"] and not one["q"]


def test_citations(spark):
    got = spark.range(1).select(citations.citations_of(F.lit("Klafki (2007) und von Saldern et al. (2012a, S. 3) zeigen (vgl. Bohnsack, 2010; Cramer & Drahmann 2019), Anfang 2022 (Jahr 2022).")).alias("c")).first()["c"]
    assert [(c["authors"], c["year"], c["suffix"]) for c in got] == [(["Klafki"], "2007", None), (["von Saldern"], "2012", "a"), (["Bohnsack"], "2010", None), (["Cramer", "Drahmann"], "2019", None)]
    bib = spark.createDataFrame([("1", "d", "Klein, P. (2012a). X."), ("2", "d", "Klein, P. (2012b). Y.")], "entry_id string, document_id string, raw_text string")
    keys = citations.bibliography_keys(bib)
    cited = spark.createDataFrame([(1, "d", "Klein", "2012", "a"), (2, "d", "Klein", "2012", "c"), (3, "d", "Klein", "2012", None), (4, "d", "Groß", "2012", None)], "citation_id int, document_id string, author string, year string, suffix string")
    assert {r["citation_id"]: r["entry_ids"] for r in citations.resolve(cited, keys).collect()} == {1: ["1"], 2: ["1", "2"], 3: ["1", "2"], 4: []}


def test_redaction_and_offsets(spark):
    t = "Anna Muster schreibt. Muster (anna.muster@x.org)"
    assert privacy.name_variants("Prof. Dr. Anna Muster")[1:] == ["Muster, Anna", "Anna Muster", "A. Muster", "Muster"]
    seeds = [("person_name", privacy.name_variants("Anna Muster"), "[NAME_001]"), ("email", ["anna.muster@x.org"], "[EMAIL_001]")]
    df = spark.createDataFrame([("d", t, seeds), ("e", "nothing", [])], "document_id string, text string, seeds array<struct<category:string,variants:array<string>,replacement:string>>")
    df = df.withColumn("edits", privacy.edits("text", "seeds"))
    out = {r["document_id"]: r for r in df.select("document_id", privacy.redacted(F.col("text"), F.col("edits")).alias("t"), privacy.moved(F.lit(0), F.lit(21), F.col("edits")).alias("a"), privacy.moved(F.lit(22), F.lit(48), F.col("edits")).alias("b")).collect()}
    assert out["d"]["t"] == "[NAME_001] schreibt. [NAME_001] ([EMAIL_001])" and out["e"]["t"] == "nothing"
    assert tuple(out["d"]["a"]) == (0, 20) and out["d"]["b"]["start"] == 21
    c = spark.createDataFrame([("d", "Matrikelnummer: 219 255-01 mail 12ab@c.de, AB@c.de ab@c.de Tel: 0911 123456 und +49 911 1234567")], "doc_id string, text string")
    got = {(r["category"], r["value"]): r["replacement"] for r in privacy.contact_seeds(c).collect()}
    assert got == {("email", "ab@c.de"): "[EMAIL_001]", ("student_id", "21925501"): "[STUDENT_ID_001]", ("phone", "0911 123456"): "[PHONE_001]", ("phone", "+49 911 1234567"): "[PHONE_002]"}
    left = privacy.leaks(df.select("document_id", "text"), spark.createDataFrame([("d", "s", ["zz", "muster"]), ("e", "s", ["no"])], "document_id string, seed_id string, variants array<string>"))
    assert [(r["document_id"], r["candidate"], r["start"]) for r in left.collect()] == [("d", "muster", 5)]


def test_argument_graph(spark):
    raw = "intro\nARGUMENT A1\nclaim: one\n goes on\npremises:\n- stated: p1\n- carried §2: p2\n- odd\nanchor: x\ngrounding: concrete\nARGUMENT A2\nclaim: two\nARGUMENT A2\nclaim: again\nARGUMENT A3\nclaim:\nEDGES\nA1 -refines-> §0:A2\nA2 -supports-> A1 (note)\nA3 -presupposes-> A1, A2\nSCAFFOLDING S1\nexcerpt: \"q\"\nfunction: didaktisch\ndescription: d\nassessment: a\nanchored_to: a1; §2:A1, ?\n"
    t = prose.argument_graph(spark.createDataFrame([("r", raw), ("e", "")], "atom_id string, raw_text string"))
    assert {(r["local_id"], r["claim"], r["grounding"]) for r in t["arguments"].collect()} == {("A1", "one\n goes on", "concrete"), ("A2", "two", "none")}
    assert [(r["type"], r["text"], r["from_paragraph"]) for r in t["premises"].orderBy("n").collect()] == [("stated", "p1", None), ("carried", "p2", 2), ("stated", "odd", None)]
    assert sorted((r["from_id"], r["to_id"], r["kind"], r["scope"]) for r in t["edges"].collect()) == [("A2", "A1", "supports", "inter_argument"), ("A3", "A1", "supports", "inter_argument"), ("A3", "A2", "supports", "inter_argument")]
    s = t["scaffolding"].first()
    assert (s["excerpt"], s["function_type"], s["anchored_to"]) == ("q", "didaktisch", ["A1", "§2:A1"])
    assert sorted(r["what"] for r in t["warnings"].collect()) == ["no claim", "no paragraph 0", "presupposes made supports", "presupposes made supports"]


def test_structured_prose(spark):
    raw = "# SUMMARY\nfirst\nsecond\n## POINT 3\ntext: three\nnote:\n a\n b\n### Other\nlost\n## POINT 1\ntext: one"
    one, items, bad = prose.structured(spark.createDataFrame([("r", raw), ("x", "nothing")], "atom_id string, raw_text string"), ["SUMMARY"], {"POINT": ["text", "note"]})
    assert [tuple(r) for r in one.collect()] == [("r", "SUMMARY", "first\nsecond")]
    assert {(r["n"], r["key"]): r["value"] for r in items.collect()} == {(3, "text"): "three", (3, "note"): "a\n b", (1, "text"): "one"}
    assert [tuple(r) for r in bad.collect()] == [("x", "header-scan")]
    j = spark.createDataFrame([('say {"a": 1} now',), ("{„a“: 2}",), ("none",)], "t string").select(prose.json_object(F.col("t"), "a int"))
    assert [r[0] and r[0]["a"] for r in j.collect()] == [1, 2, None]


def test_annotation_summaries(spark):
    t = "Zusammenfassung der Anmerkungen in x.pdf\n1.2 Kapitel\nHervorheben [Seite 3]: quoted\nmore\n\n12\nNotiz [Seite 4]: \nmy note\nUnterstreichen [Seite 5]: u\n\nSchluss\nText [Seite 6]: t"
    got = formats.annotations(spark.createDataFrame([("d", t)], "doc_id string, text string")).orderBy("idx").collect()
    assert [(r["kind"], r["content"], r["page"], r["chapter"], r["paired_with"], r["level"]) for r in got] == [
        ("heading", "1.2 Kapitel", None, None, None, 2), ("annotation", "quoted\nmore", 3, "1.2 Kapitel", None, None), ("annotation", "my note", 4, "1.2 Kapitel", 1, None),
        ("annotation", "u", 5, "1.2 Kapitel", None, None), ("heading", "Schluss", None, None, None, 1), ("annotation", "t", 6, "Schluss", 3, None),
    ]
    p = formats.paragraphs(spark.createDataFrame([("d", "One.\n\n \nTwo. Three\n\n\n"), ("e", "")], "doc_id string, text string")).orderBy("seq").collect()
    assert [(r["content"], r["char_start"], r["char_end"]) for r in p] == [("One.", 0, 4), ("Two. Three", 8, 18)]


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="", more="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r>{more}</w:p>'
    body = para("Titel") + para("Einleitung", "H1") + para("Ein Satz, der") + para("weitergeht.", more='<w:r><w:footnoteReference w:id="2"/></w:r>') + para("Neu.") + para("Unter", "Sub") + para("Text.") + para("Literatur", "H1") + para("Klein 2012.")
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Überschrift 2"/></w:style><w:style w:styleId="Sub"><w:name w:val="own"/><w:basedOn w:val="H2"/></w:style></w:styles>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:id="2"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnote></w:footnotes>')
    files = spark.createDataFrame([("d", bytearray(buffer.getvalue())), ("bad", bytearray(b"no zip")), ("none", None)], "document_id string, content binary")
    p = docx.paragraphs(files).cache()
    assert {r["document_id"] for r in p.where("error is not null").collect()} == {"bad", "none"}
    e = docx.document_elements(p).orderBy("seq").collect()
    assert [(r["element_type"], r["content"], r["level"], r["section_kind"], r["position_role"]) for r in e] == [
        ("paragraph", "Titel", None, "front_matter", "before_heading"), ("heading", "Einleitung", 1, "main", None), ("paragraph", "Ein Satz, der weitergeht.", None, "main", "before_heading"),
        ("paragraph", "Neu.", None, "main", "before_heading"), ("heading", "Unter", 2, "main", None), ("paragraph", "Text.", None, "main", "before_heading"),
        ("heading", "Literatur", 1, "bibliography", None), ("paragraph", "Klein 2012.", None, "bibliography", "after_heading"),
    ]
    assert docx.toc_references(p).count() == 0
    assert [(r["idx"], r["note_text"]) for r in docx.footnotes(p).collect()] == [(3, "Note")]
    md = export.markdown(docx.document_elements(p)).first()["markdown"]
    assert md.startswith("Titel\n\n# Einleitung\n\nEin Satz") and "## Unter" in md


def test_validity_answers(spark):
    raw = "## VALIDITY A1\ncarries: yes\nform: inductive\nrationale: r\n more\n**VALIDITY A2**\ncarries: no\nfallacy: circular\ntarget: p1\nrationale: x\nVALIDITY A3\ncarries: no\nfallacy: unknown\ntarget: p\nrationale: y\nVALIDITY A9\ncarries: yes\nform: deductive\nrationale: z"
    known = spark.createDataFrame([("r", f"A{k}") for k in (1, 2, 3)], "atom_id string, local_id string")
    got = prose.validity(spark.createDataFrame([("r", raw)], "atom_id string, raw_text string"), known, ["circular"]).orderBy("local_id").collect()
    assert [(r["local_id"], r["carries"], r["form"], r["fallacy"], r["target"], r["rationale"]) for r in got] == [("A1", True, "inductive", None, None, "r\n more"), ("A2", False, None, "circular", "p1", "x")]


def test_ranks_histograms_and_blocks(spark):
    answers = spark.createDataFrame([("u", "Nr. 2", " a "), ("u", "0", "b"), ("u", "x", "c"), ("u", "9", "d")], "unit string, number string, rationale string")
    pool = spark.createDataFrame([("u", 1, "n1"), ("u", 2, "n2")], "unit string, rank int, node_id string")
    assert [tuple(r) for r in review.by_rank(answers, pool).collect()] == [("u", 2, "n2", "a")]
    p = spark.createDataFrame([("s", "stated"), ("s", "stated"), ("s", "carried")], "section string, type string")
    assert review.premise_histogram(p, ["section"]).first()["histogram"] == "carried:1 stated:2"
    m = spark.createDataFrame([("k", 2, "B", "y"), ("k", 1, "A", "x")], "k string, o int, t string, b string")
    assert review.format_blocks(m, "k", "t", "b", "o").first()["block"] == "## A\nx\n\n## B\ny"


def test_roles_of_persons(spark):
    t = "Betreuerin: Prof. Dr. Eva Klein\nvorgelegt von Max Groß" + " " * 200 + "Lea Kurz"
    docs = spark.createDataFrame([("d", t)], "document_id string, text string")
    labels = privacy.role_labels(docs)
    assert {(r["pos"], r["role"]) for r in labels.collect()} == {(t.index("Betreuerin"), "supervisor"), (t.index("vorgelegt"), "author")}
    persons = spark.createDataFrame([("d", n, t.index(n)) for n in ("Eva Klein", "Max Groß", "Lea Kurz")] + [("e", "Ida Neu", 5), ("e", "Tom Alt", 90)], "document_id string, text string, start int")
    got = {r["text"]: r["role"] for r in privacy.person_roles(persons, labels).collect()}
    assert got == {"Eva Klein": "supervisor", "Max Groß": "author", "Lea Kurz": "other", "Ida Neu": "author", "Tom Alt": "other"}
    two = spark.createDataFrame([("d", "Eva Klein Prof. Dr. Max Groß", 10), ("d", "Single", 0)], "document_id string, text string, start int")
    assert sorted((r["text"], r["start"]) for r in privacy.split_persons(two).collect()) == [("Eva Klein", 10), ("Max Groß", 30)]
    hint = docs.select(privacy.title_hint(F.lit("Titel: Ein langer Titel\nx"), F.array(F.lit("a"))).alias("a"), privacy.title_hint(F.lit("nothing"), F.array(F.lit("short"), F.lit("A longer name of a work"))).alias("b")).first()
    assert tuple(hint) == ("Ein langer Titel", "A longer name of a work")


def test_tables_of_contents(spark):
    rows = [("d", 0, "1 Start .... 3", None, 1, None, "b1"), ("d", 1, "1.1 Next 4", None, 2, "", "b2"), ("d", 2, "1 Start", 3, None, "b1", None), ("d", 3, "1.2 Next", None, None, "b2", None), ("d", 4, "again", None, None, "b2", None), ("d", 5, "Literatur", 1, None, None, None), ("d", 6, "Klein", None, None, None, None), ("d", 7, "Groß", None, None, None, None)]
    p = spark.createDataFrame([(*r, None, [], False, None, None, None) for r in rows], "document_id string, idx int, text string, level int, toc int, anchor string, link string, ilvl int, notes array<int>, drawing boolean, note_text string, error string, style_id string")
    got = sorted((r["toc_idx"], r["title"], r["level"], r["heading_idx"], r["mismatch"]) for r in docx.toc_references(p).collect())
    assert got == [(0, "1 Start", 1, 2, False), (1, "1.1 Next", 2, 3, True)]
    e = docx.document_elements(p).orderBy("seq").collect()
    assert [(r["element_type"], r["content"], r["level"]) for r in e] == [("toc_entry", "1 Start .... 3", None), ("toc_entry", "1.1 Next 4", None), ("heading", "1 Start", 1), ("heading", "1.2 Next", 2), ("paragraph", "again", None), ("heading", "Literatur", 1), ("paragraph", "Klein", None), ("paragraph", "Groß", None)]


def test_outlines_of_many_headings_take_linear_time(spark):
    """One document of a hundred thousand headings, and some of one."""
    import time

    e = spark.range(100_000).select(F.lit("d").alias("document_id"), (F.col("id") * 10).alias("char_start"), (F.col("id") * 10 + 5).alias("char_end"), F.lit("heading").alias("element_type"), (F.xxhash64("id") % 5 + 6).cast("int").alias("level"))
    e = e.unionByName(spark.createDataFrame([("x", 0, 4, "heading", None), ("y", 0, 4, "heading", 3), ("y", 9, 12, "heading", None)], "document_id string, char_start long, char_end long, element_type string, level int"))
    began = time.perf_counter()
    numbers, ends = positions.numbering(e).collect(), positions.unit_ends(e).collect()
    assert time.perf_counter() - began < 30 and len(numbers) == len(ends) == 100_003
    level = {(r["document_id"], r["char_start"]): r["level"] for r in ends}
    for r in ends[:2000]:
        if r["level"] is not None and r["document_id"] == "d":
            later = (at for at in range(r["char_start"] + 10, 1_000_000, 10) if level["d", at] <= r["level"])
            assert r["unit_end"] == next(later, 999_995)
    got = {(r["document_id"], r["char_start"]): r["numbering"] for r in numbers if r["document_id"] != "d"}
    assert got == {("x", 0): None, ("y", 0): "0.0.1", ("y", 9): None}


def test_nearest_pairs_are_brute_force(spark):
    import numpy as np

    from quillspark.plans import vectors

    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 4)]) for k in range(160)] + [(200, [0.0] * 4), (300, [0.0] * 4)]
    a, b = rows[::2], rows[1::2]
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / np.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    best = [min((-cos(v, w), j, i) for j, w in b if any(w)) for i, v in a if any(v)]
    want = sorted((round(s, 6), i, j) for s, j, i in best)[:25]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, v array<double>")
    for block in (7, 2048):
        got = [(-r["similarity"], r["a_id"], r["b_id"]) for r in vectors.nearest_pairs(frame(a), frame(b), 25, block).collect()]
        assert [x[0] for x in got] == [x[0] for x in want] and {x[1]: x[2] for x in got}.items() <= {i: j for _, j, i in best}.items()
    assert vectors.nearest_pairs(frame(a).limit(0), frame(b), 5).count() == 0
