"""Plain text, annotation summaries and their dispatch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import offsets
from quillspark.functions.text import german_sentences

# The summary's first line and its entries.
SUMMARY = r"^Zusammenfassung der Anmerkungen in (.+?)\.(pdf|PDF)\.?\s*$"
ENTRY = r"^(Hervorheben|Wellenlinie|Unterstreichen|Notiz|Text|Rechteck) \[Seite (\d+)\]: ?(.*)$"
CITING = ("Hervorheben", "Wellenlinie", "Unterstreichen")


def file_format(mime: Column, text: Column) -> Column:
    """docx, annotations or plain-text, by type and first line."""
    docx = mime.contains("wordprocessingml") | (mime == "application/msword")
    return F.when(docx, "docx").when(F.element_at(F.split(text, r"\r?\n"), 1).rlike(SUMMARY), "annotations").otherwise("plain-text")


def paragraphs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(document_id, seq, char_start, char_end, content): chunks between blank
    lines, white space and all; blank ones are left out."""
    gap = r"\n\s*\n"
    rows = df.select(F.col(doc_id).alias("document_id"), F.split(text, gap).alias("c"), F.concat(F.regexp_extract_all(text, F.lit(gap), F.lit(0)), F.array(F.lit(""))).alias("g"))
    rows = rows.withColumn("s", offsets(F.zip_with("c", "g", lambda c, g: F.length(c) + F.length(F.coalesce(g, F.lit(""))))))
    out = rows.select("document_id", F.posexplode(F.arrays_zip("c", "s")).alias("seq", "p"))
    out = out.select("document_id", "seq", F.col("p.c").alias("content"), F.col("p.s").alias("char_start"), (F.col("p.s") + F.length("p.c")).alias("char_end"))
    return out.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def sentence_elements(p: DataFrame) -> DataFrame:
    """Sentences of paragraphs, with their places in the document."""
    s = p.select("document_id", F.col("seq").alias("paragraph"), F.col("char_start").alias("base"), F.posexplode(german_sentences("content")).alias("n", "s"))
    return s.select("document_id", "paragraph", "n", F.col("s.text").alias("content"), (F.col("base") + F.col("s.start")).alias("char_start"), (F.col("base") + F.col("s.end")).alias("char_end"))


_ANY, _END = r"[^\n\r\u0085\u2028\u2029]", r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"  # as Spark's patterns read . and $


def _form(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(".+", _ANY + "+").replace(".*", _ANY + "*").replace("$", _END), re.ASCII)


_SUMMARY, _ENTRY, _NUMBER, _PAGE = _form(SUMMARY), _form(ENTRY), _form(r"^(\d+(?:\.\d+)*)\s+.+$"), _form(r"^\d+$")
_RETURN, _SPACE = _form(r"\r$"), _form(r"^\s+|\s+$")
_ELEMENTS = {"kind": pa.string(), "content": pa.string(), "type": pa.string(), "page": pa.int32(), "idx": pa.int32(), "level": pa.int32(), "chapter": pa.string(), "semantic": pa.string(), "paired_with": pa.int32(), "char_start": pa.int64(), "char_end": pa.int64()}


def _stripped(text: str) -> str:
    odd = any(x in text for x in "\u0085\u2028\u2029")
    return _SPACE.sub("", text) if odd else text.strip(" \t\n\r\f\v")


def _entries(text: str) -> Iterator[tuple]:
    """(kind, content, type, page) of a summary, in their order."""
    open_: tuple | None = None  # type, page and lines of the entry that goes on
    for k, line in enumerate(text.split("\n")):
        line = _RETURN.sub("", line) if "\r" in line else line
        if k == 0 and _SUMMARY.match(line):
            continue
        t = _stripped(line).strip(" ")
        entry = _ENTRY.match(t)
        if open_ and (entry or not t):
            yield "annotation", _stripped("\n".join(open_[2])), *open_[:2]
            open_ = None
        if entry:
            page = int(entry[2])
            open_ = entry[1], page if page < 1 << 31 else None, [entry[3]] if entry[3] else []
        elif open_:
            open_[2].append(line)
        elif t and not _PAGE.match(t):
            yield "heading", _stripped(line), None, None
    if open_:
        yield "annotation", _stripped("\n".join(open_[2])), *open_[:2]


def _elements(text: str) -> Iterator[tuple]:
    chapter, cited, at = None, None, 0
    for k, (kind, content, type_, page) in enumerate(_entries(text)):
        if kind == "heading":
            chapter, number = content, _NUMBER.match(content)
            row = (number[1].count(".") + 1 if number else 1, None, None, None)
        elif type_ in CITING:
            row, cited = (None, chapter, "citing", None), k
        else:
            row = (None, chapter, "commenting", cited)
        yield kind, content, type_, page, k, *row, at, at + len(content)
        at += len(content) + 1


def annotations(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Elements of annotation summaries: chapter headings and annotations, read
    in one pass over the lines of each text; nothing is shuffled.

    An entry takes the lines after it up to a blank one or the next entry; a
    comment names the citing entry before it; every entry has the chapter
    heading before it as context.
    """
    own = df.select(F.col(doc_id).alias("document_id"), F.col(text).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(b: pa.RecordBatch, keys: list[int], rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [()] * len(_ELEMENTS)
            return pa.record_batch([b.column("document_id").take(pa.array(keys, pa.int64())), *[pa.array(c, kind) for c, kind in zip(cols, _ELEMENTS.values(), strict=True)]], names=["document_id", *_ELEMENTS])

        for b in batches:
            keys, rows = [], []
            for k, t in enumerate(b.column("text")):
                for row in _elements(t.as_py()):
                    keys.append(k)
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(b, keys, rows)
                        keys, rows = [], []
            yield batch(b, keys, rows)

    kind = own.schema["document_id"].dataType.simpleString()
    return own.mapInArrow(run, f"document_id {kind}, kind string, content string, type string, page int, idx int, level int, chapter string, semantic string, paired_with int, char_start long, char_end long")
