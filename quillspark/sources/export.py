"""Exports of an outline: Markdown and JSON, one row for each document."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(e: DataFrame) -> DataFrame:
    """(document_id, markdown) of elements: headings by level, blank lines between."""
    block = F.when(F.col("element_type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("content"))).otherwise(F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("char_start", block.alias("b"))))
    return e.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x.b), "\n\n").alias("markdown"))


def json_outline(e: DataFrame) -> DataFrame:
    """(document_id, outline): headings as a JSON array."""
    row = F.struct("char_start", "level", "content")
    return e.where("element_type = 'heading'").groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("outline"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_STYLES = f"<w:styles {_W}>" + "".join(f'<w:style w:styleId="H{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 10)) + "</w:styles>"
SENT = 1 << 20  # about as many bytes leave a task at once
_NO_XML = re.compile("[^\\t\\n\\r\\u0020-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


def _docx(rows: list[dict]) -> bytes:
    """A DOCX file of elements: a paragraph each, headings by their style."""

    def paragraph(r: dict) -> str:
        style = f'<w:pPr><w:pStyle w:val="H{r["level"]}"/></w:pPr>' if r["element_type"] == "heading" and r["level"] else ""
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(_NO_XML.sub("", r["content"] or ""))}</w:t></w:r></w:p>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("word/document.xml", f"<w:document {_W}><w:body>{''.join(map(paragraph, rows))}</w:body></w:document>"), ("word/styles.xml", _STYLES)):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), body)  # the same bytes at each run
    return buffer.getvalue()


def docx(e: DataFrame) -> DataFrame:
    """(document_id, content): each document's elements as the bytes of a DOCX
    file; levels from 1 to 9, characters that XML lacks are left out."""
    row = F.struct("char_start", "element_type", "level", "content")
    whole = e.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # a file is one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, made, size = 0, [], 0
            for k, r in enumerate(b.column("rows")):  # one document at a time is Python's
                made.append(_docx(r.as_py()))
                size += len(made[-1])
                if size >= SENT or k == b.num_rows - 1:
                    yield pa.record_batch([b.column("document_id").slice(first, len(made)), pa.array(made, pa.binary())], names=["document_id", "content"])
                    first, made, size = k + 1, [], 0

    return whole.mapInArrow(run, f"document_id {whole.schema['document_id'].dataType.simpleString()}, content binary")


def write(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)
