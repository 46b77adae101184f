"""DOCX files: paragraphs from the package, structure from windows.

Python reads the archive of one file at a time and returns its paragraphs with
style, text and markers; headings, numbering, roles, offsets, captions and
footnotes are settled by DataFrame operations over all files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import german_sentences

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROWS = "document_id string, idx int, style_id string, text string, level int, toc int, ilvl int, anchor string, link string, notes array<int>, drawing boolean, note_text string, error string, markers array<struct<marker:string,at:int>>, drawings array<string>"
SCHEMA = pa.schema([
    ("document_id", pa.string()), ("idx", pa.int32()), ("style_id", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("toc", pa.int32()), ("ilvl", pa.int32()),
    ("anchor", pa.string()), ("link", pa.string()), ("notes", pa.list_(pa.int32())), ("drawing", pa.bool_()), ("note_text", pa.string()), ("error", pa.string()),
    ("markers", pa.list_(pa.struct([("marker", pa.string()), ("at", pa.int32())]))), ("drawings", pa.list_(pa.string())),
])
# Names that styles of headings begin with.
HEADING_NAMES = ("heading ", "überschrift ", "ueberschrift ")
BIBLIOGRAPHY = r"(?iu)^\W*(\d[\d.]*\s+)?(literatur|bibliogra|quellen|references)"
TOC_NAMES = ("toc ", "verzeichnis ")
# Captions by style and by their words, page numbers, and what stands for a file that can't be read.
CAPTION_STYLE = r"(?iu)^(caption|beschriftung|bildunterschrift|tabellen?(?:beschriftung|titel))\b"
CAPTION_WORDS = r"(?iu)^(abb(?:\.|ildung)|tab(?:\.|elle)|fig(?:\.|ure)|schaubild|diagramm)\s*\d"
PAGE_NUMBER = r"^\s*\d{1,5}\s*$"
SENT = 1 << 20  # about as many characters leave a task at once
FAILED = "[DOCX text extraction failed]"


def style_levels(xml: bytes, names: tuple[str, ...]) -> dict[str, int]:
    """Level of each style, by its name or that of one it is based on."""
    own, base = {}, {}
    for s in ElementTree.fromstring(xml).iter(f"{W}style"):
        key, name, up = s.get(f"{W}styleId"), s.find(f"{W}name"), s.find(f"{W}basedOn")
        label = (name.get(f"{W}val") if name is not None else "").strip().lower()
        for start in names:
            if label.startswith(start) and label[len(start) :].strip().isdigit():
                own[key] = int(label[len(start) :])
        base[key] = up.get(f"{W}val") if up is not None else None
    out = {}
    for key in base:
        seen, at = set(), key
        while at and at not in own and at not in seen:
            seen.add(at)
            at = base.get(at)
        if at in own:
            out[key] = own[at]
    return out


def superscript_styles(xml: bytes) -> set[str]:
    """Styles that are superscript themselves or by one they are based on."""
    above, base = set(), {}
    for s in ElementTree.fromstring(xml).iter(f"{W}style"):
        key, up = s.get(f"{W}styleId"), s.find(f"{W}basedOn")
        base[key] = up.get(f"{W}val") if up is not None else None
        if any(v.get(f"{W}val") == "superscript" for v in s.findall(f"{W}rPr/{W}vertAlign")):
            above.add(key)
    while more := {k for k, up in base.items() if up in above and k not in above}:
        above |= more
    return above


def _paragraph(p, above: set[str]) -> dict:
    style, level, mark = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}numPr/{W}ilvl"), p.find(f"{W}bookmarkStart")
    link = next(p.iter(f"{W}hyperlink"), None)
    text, notes, markers, drawings = [], [], [], []

    def raised(run) -> bool:
        return any(v.get(f"{W}val") == "superscript" for v in run.findall(f"{W}rPr/{W}vertAlign")) or any(v.get(f"{W}val") in above for v in run.findall(f"{W}rPr/{W}rStyle"))

    def walk(node, inside: bool) -> None:
        if node.tag in (f"{W}drawing", f"{W}pict"):
            boxes = list(node.iter(f"{W}txbxContent"))
            drawings.append("".join(t.text or "" for t in boxes[0].iter(f"{W}t")).strip() if boxes else None)
            return
        at = len("".join(text)) if node.tag == f"{W}r" and not inside and raised(node) else None
        if node.tag == f"{W}t":
            text.append(node.text or "")
        elif node.tag in (f"{W}tab", f"{W}br"):
            text.append(" ")
        elif node.tag == f"{W}footnoteReference":
            notes.append(int(node.get(f"{W}id")))
        for child in node:
            walk(child, inside or at is not None)
        if at is not None and (number := "".join(text)[at:].strip()).isdecimal():
            markers.append({"marker": number, "at": at})

    for child in p:
        walk(child, False)
    whole = "".join(text)
    front = len(whole) - len(whole.lstrip())
    val = lambda n: n.get(f"{W}val") if n is not None else None
    return {
        "style_id": val(style), "text": whole.strip(), "ilvl": int(val(level)) if val(level) else None,
        "anchor": mark.get(f"{W}name") if mark is not None else None, "link": link.get(f"{W}anchor") if link is not None else None, "notes": notes, "drawing": bool(drawings),
        "markers": [{"marker": m["marker"], "at": max(0, m["at"] - front)} for m in markers], "drawings": drawings,
    }


def _body_paragraphs(node) -> Iterator:
    """Paragraphs of a body, but for those in text boxes."""
    for child in node:
        if child.tag == f"{W}p":
            yield child
        elif child.tag not in (f"{W}drawing", f"{W}pict"):
            yield from _body_paragraphs(child)


def read_paragraphs(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        styles = z.read("word/styles.xml") if "word/styles.xml" in names else b"<x/>"
        levels, contents = style_levels(styles, HEADING_NAMES), style_levels(styles, TOC_NAMES)
        body = ElementTree.fromstring(z.read("word/document.xml"))
        above = superscript_styles(styles)
        out = [_paragraph(p, above) for p in _body_paragraphs(body)]
        for r in out:
            r["level"], r["toc"] = levels.get(r["style_id"]), contents.get(r["style_id"])
        if "word/footnotes.xml" in names:
            for n in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{W}footnote"):
                if n.get(f"{W}type") is None:
                    out.append({"notes": [int(n.get(f"{W}id"))], "note_text": "".join(t.text or "" for t in n.iter(f"{W}t")).strip()})
    return out


def _rows(key: str | None, content: bytes | None) -> list[dict]:
    try:
        return [{"document_id": key, "idx": i, **r} for i, r in enumerate(read_paragraphs(content))]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
        return [{"document_id": key, "idx": -1, "error": f"{type(e).__name__}: {e}"}]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for b in batches:
        for key, content in zip(b.column("document_id"), b.column("content"), strict=True):
            for r in _rows(key.as_py(), content.as_py()):
                rows.append(r)
                size += 200 + len(r.get("text") or "") + len(r.get("note_text") or "")
                if size >= SENT:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of files (document_id, content); a file that can't be read
    gives one row with its error."""

    return files.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInArrow(_read, ROWS)


def _is_caption() -> Column:
    return F.coalesce(F.col("style_id").rlike(CAPTION_STYLE), F.lit(False)) | F.col("text").rlike(CAPTION_WORDS) & (F.length("text") <= 300)


def flat_text(files: DataFrame) -> DataFrame:
    """(document_id, text): the paragraphs of each file one under another; of
    one that can't be read, what says so."""
    p = paragraphs(files).where("note_text is null")
    parts = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("idx", F.concat("text", F.lit("\n\n")).alias("t")))))
    whole = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    return p.groupBy("document_id").agg(F.when(F.max("error").isNotNull(), FAILED).otherwise(whole).alias("text"))


def drawings(p: DataFrame) -> DataFrame:
    """(document_id, idx, pos, kind, content) of drawings: figures, page numbers,
    and notes (other text boxes)."""
    d = p.where("drawing").select("document_id", "idx", F.posexplode("drawings").alias("pos", "content"))
    return d.withColumn("kind", F.when(F.coalesce("content", F.lit("")) == "", "figure").when(F.col("content").rlike(PAGE_NUMBER), "page_marker").otherwise("footnote"))


def captions(p: DataFrame) -> DataFrame:
    """(document_id, idx, figure): captions, and the last figure of the same
    paragraph (its position there; null if there is none)."""
    last = drawings(p).where("kind = 'figure'").groupBy("document_id", "idx").agg(F.max("pos").alias("figure"))
    return p.where("error is null and note_text is null and text <> ''").where(_is_caption()).select("document_id", "idx").join(last, ["document_id", "idx"], "left")


def note_bindings(p: DataFrame) -> DataFrame:
    """(document_id, idx, marker, sentence, note): raised numbers bound to the
    sentence of their paragraph that holds them, else to the last that ends
    before; the n-th of a document goes with its n-th note in a text box."""
    m = p.where("size(markers) > 0").withColumn("s", german_sentences("text")).select("document_id", "idx", "s", F.posexplode("markers").alias("pos", "m"))
    at = F.col("m.at")
    holds = F.get(F.filter("s", lambda x: (x["start"] <= at) & (at <= x["end"])), F.lit(0))
    past = F.filter("s", lambda x: x["end"] <= at)
    before = F.when(F.size(past) > 0, F.element_at(past, -1)).otherwise(F.get("s", F.lit(0)))
    w = Window.partitionBy("document_id")
    m = m.select("document_id", "idx", F.col("m.marker").alias("marker"), F.coalesce(holds, before)["text"].alias("sentence"), F.row_number().over(w.orderBy("idx", "pos")).alias("n"))
    notes = drawings(p).where("kind = 'footnote'").select("document_id", F.col("content").alias("note"), F.row_number().over(w.orderBy("idx", "pos")).alias("n"))
    return m.join(notes, ["document_id", "n"], "left").select("document_id", "idx", "marker", "sentence", "note")


def document_elements(p: DataFrame) -> DataFrame:
    """Elements of paragraphs: prose broken by soft returns is joined (but for
    the entries of a bibliography), a heading's level is that of its entry in
    the table of contents, else of its style; then (document_id, seq, element_type, content, level, numbering, section_kind,
    position_role, char_start, char_end)."""
    w = Window.partitionBy("document_id").orderBy("idx")
    b = p.where("error is null and note_text is null and (text <> '' or drawing)")
    known = toc_references(p).groupBy("document_id", F.col("heading_idx").alias("idx")).agg(F.min("level").alias("_toc"))
    # by document alone, as the windows: one shuffle
    known = known.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "_toc"))).alias("_known"))
    b = b.join(known, "document_id", "left").withColumn("level", F.coalesce(F.element_at("_known", F.col("idx")), "level")).drop("_known")
    kind = F.when(F.col("toc").isNotNull(), "toc_entry").when(F.col("level").isNotNull(), "heading").when(F.col("drawing") & (F.col("text") == ""), "figure")
    kind = kind.when(_is_caption(), "caption").otherwise("paragraph")
    b = b.withColumn("element_type", kind)
    books = F.when(F.col("element_type") == "heading", F.when(F.col("text").rlike(BIBLIOGRAPHY), F.col("level")).otherwise(-F.col("level")))
    b = b.withColumn("_books", F.last(books, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a paragraph that does not end a sentence goes on in the next one
    joins = (F.lag("element_type").over(w) == "paragraph") & (F.col("element_type") == "paragraph") & ~F.lag("text").over(w).rlike(r"[.?!…:]$") & ~F.coalesce(F.col("_books") > 0, F.lit(False))
    b = b.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x.text)
    e = b.groupBy("document_id", "seq").agg(F.min("element_type").alias("element_type"), F.array_join(parts, " ").alias("content"), F.min("level").alias("level"), F.min("anchor").alias("anchor"))
    w = Window.partitionBy("document_id").orderBy("seq")
    upto, later = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    head = F.col("element_type") == "heading"
    opens = F.when(head & F.col("content").rlike(BIBLIOGRAPHY), "bibliography").when(head & F.col("content").rlike(r"(?iu)^\W*(anhang|appendix)"), "appendix").when(head, "main")
    top = F.when(head & (F.col("level") == 1) | opens.isin("bibliography", "appendix"), opens)
    e = e.withColumn("section_kind", F.coalesce(F.last(top, ignorenulls=True).over(upto), F.lit("front_matter")))
    role = F.when(~head, F.when(F.max(head).over(later), "before_heading").when(F.lag(head).over(w), "after_heading").otherwise("mid"))
    start = F.coalesce(F.sum(F.length("content") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return e.withColumn("position_role", role).withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("content"))


def toc_references(p: DataFrame) -> DataFrame:
    """(document_id, toc_idx, title, level, number, heading_idx, mismatch):
    entries of tables of contents with the first heading that bears their
    bookmark; the page number at the end goes, and ``mismatch`` tells that the
    entry's number is not the heading's."""
    clean = F.trim(F.regexp_replace("text", r"[\s.]*\d+$", ""))
    number = lambda c: F.nullif(F.regexp_extract(c, r"^(\d+(?:\.\d+)*)\b", 1), F.lit(""))
    entries = p.where("toc is not null and text <> ''").select("document_id", F.col("idx").alias("toc_idx"), clean.alias("title"), F.coalesce(F.col("ilvl") + 1, F.col("toc")).alias("level"), F.col("link").alias("anchor"))
    heads = p.where("anchor is not null and toc is null").groupBy("document_id", "anchor").agg(F.min("idx").alias("heading_idx"), F.min_by("text", "idx").alias("heading"))
    j = entries.join(heads, ["document_id", "anchor"])
    a, b = number("title"), number("heading")
    return j.select("document_id", "toc_idx", "title", "level", a.alias("number"), "heading_idx", (a.isNotNull() & b.isNotNull() & (a != b)).alias("mismatch"))


def footnotes(p: DataFrame) -> DataFrame:
    """(document_id, idx, note_text): footnotes paired with the paragraphs that
    refer to them, by order."""
    w = Window.partitionBy("document_id").orderBy("idx", "pos")
    refs = p.where("note_text is null").select("document_id", "idx", F.posexplode("notes").alias("pos", "note")).withColumn("n", F.row_number().over(w))
    notes = p.where("note_text is not null").withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("idx"))).select("document_id", "n", "note_text")
    return refs.join(notes, ["document_id", "n"]).select("document_id", "idx", "note_text")
