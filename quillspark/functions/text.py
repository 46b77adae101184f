"""Text expressions: formats, normal forms, spans, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.arrays import let, offsets

# MIME types by file extension.
MIME = {
    "pdf": "application/pdf",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
}
#: Ordered rewrites of HTML to text: pattern and replacement.
HTML_REWRITES = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</p>", "\n\n"),
    (r"(?i)</div>", "\n"),
    (r"(?i)</h[1-6]>", "\n\n"),
    (r"(?i)</li>", "\n"),
    (r"<[^>]+>", ""),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#039;", "'"),
    ("&nbsp;", " "),
    (r"\n{3,}", "\n\n"),
)


def mime_type(name: str | Column) -> Column:
    """MIME type by the extension of a file name."""
    ext = F.element_at(F.split(F.lower(name), r"\."), -1)
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.element_at(known, ext), F.lit("application/octet-stream"))


def html_to_text(html: str | Column) -> Column:
    """Text of HTML by ordered rewrites: a chain of built-in expressions."""
    out = F.col(html) if isinstance(html, str) else html
    for pattern, new in HTML_REWRITES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def read_text(content: Column, mime: Column) -> Column:
    """Text of a file's bytes by its type; kinds without a reader are empty."""
    plain = F.decode(content, "UTF-8")
    return F.when(mime == "text/plain", plain).when(mime == "text/html", html_to_text(plain)).otherwise("")


def heading_label(text: str | Column) -> Column:
    """White space as single spaces, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def snippet(text: str | Column, most: int = 140) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(col) <= most, col).otherwise(F.concat(F.rtrim(F.substring(col, 1, most - 1)), F.lit("…")))


def span(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text; null for a span that is none."""
    ok = (start >= 0) & (end >= start) & (end <= F.length(text))
    return F.when(ok, F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def file_stem(name: str | Column) -> Column:
    """A name fit for files: German letters spelt out, the rest dashes."""
    out = F.lower(name)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


# Words that say nothing of a work, and titles of persons.
NO_TITLE_WORDS = (
    "der die das den dem des eine einen einem einer eines the and for with from into onto upon le la les un une des aux el los las unos unas il lo gli "
    "zur zum beim vom als sind werden wird wurde kann soll über unter zwischen gegen trotz wegen on in of to a an is are was were be been "
    "inhaltsverzeichnis abkürzungsverzeichnis abkuerzungsverzeichnis abbildungsverzeichnis tabellenverzeichnis symbolverzeichnis literaturverzeichnis literatur quellenverzeichnis "
    "anhang anhänge anhange einleitung fazit zusammenfassung abstract vorwort danksagung erklärung erklaerung eidesstattliche selbstständigkeitserklärung selbststaendigkeitserklaerung "
    "einverständniserklärung einverstaendniserklaerung lebenslauf introduction conclusion appendix appendices bibliography references acknowledgements preface foreword glossary kapitel chapter chapitre"
).split()
TITLES = r"(?i)\b(?:prof(?:essor)?|dr|ph\.?\s*d|m\.?\s*a|b\.?\s*a|m\.?\s*sc|b\.?\s*sc|hon|priv[.-]?doz|sir|mr|mrs|ms|mme|sra|sr|dipl[.-]?ing|mag|doc|kand|ass|phil|theol|med|iur|nat|h\.\s*c|h\.c)\.?(?=\b)"


def title_word(title: Column) -> Column:
    """The first word of a title that says something: of four letters or more,
    no function word, capitalised if there is such a one."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(title, TITLES, ""), r"\s+", " ")), "^[ ,;:.-]+|[ ,;:.-]+$", ""), r"[^\p{L}\p{N}\s-]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda x: F.length(x) >= 4)
    telling = F.filter(words, lambda x: ~F.lower(x).isin(NO_TITLE_WORDS))
    large = F.filter(telling, lambda x: x.rlike("^[A-ZÄÖÜÅÆØÀ-ɏ]"))
    return F.coalesce(F.get(large, F.lit(0)), F.get(telling, F.lit(0)), F.get(words, F.lit(0)), F.lit("anonym"))


def synthetic_name(kind: Column, day: Column, title: Column, extension: Column) -> Column:
    """A file name that tells a document's kind, date and one word of its title."""

    def token(x: Column, most: int) -> Column:
        for a, b in zip("äöüÄÖÜß", ("ae", "oe", "ue", "Ae", "Oe", "Ue", "ss"), strict=True):
            x = F.replace(x, F.lit(a), F.lit(b))
        x = F.substring(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "[^a-zA-Z0-9À-ɏ_-]", ""), 1, most)
        return F.when(x == "", "anonym").otherwise(x)

    word = F.when(F.coalesce(title, F.lit("")) == "", "anonym").otherwise(token(title_word(title), 24))
    return F.concat(token(kind, 16), F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_"), word, F.lit("."), F.regexp_replace(extension, r"^\.", ""))


def straight_quotes(text: str | Column) -> Column:
    """Typographic quotation marks as plain ones."""
    return F.regexp_replace(F.regexp_replace(text, "[„“”«»]", '"'), "[‚‘’]", "'")


# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = (
    r"vgl siehe bspw z\.B zB i\.S\.v i\.S\.d u\.a u\.Ä d\.h d\.Ä bzw ggf evtl ca inkl exkl sog i\.d\.R i\.A "
    r"S Bd Nr Abs Art Aufl Hrsg Jg Kap Anh Abschn Abb Tab Fig Bsp Mio Mrd Mill "
    r"e\.g i\.e cf vol pp fig ed eds ibid Prof Dr Dipl Mag PhD"
).split() + [r"et al", r"op\. cit", r"vgl\.\s+a"]
_MARK, _CUT = "\ufdd0", "\ufdd1"  # no characters of any text
SENTENCE = "struct<text:string,start:int,end:int>"


def _held(text: Column) -> Column:
    """Full stops of abbreviations and initials as marks of the same length; what
    stands before a full stop is looked at only where there is one."""
    before = "|".join(x.replace(r"\s+", r"\s{1,8}") for x in ABBREVIATIONS)
    out = F.regexp_replace(text, rf"\.(?<=(?<![A-Za-z0-9_])(?i:{before})\.)", _MARK)
    return F.regexp_replace(out, r"\.(?<=(?<![A-Za-z0-9_])[A-ZÄÖÜ]\.)(?=[\s\u00A0]?[A-ZÄÖÜ-])", _MARK)


def _sentences(text: Column, ends: str) -> Column:
    def one(part: Column, start: Column) -> Column:
        front = F.length(part) - F.length(F.regexp_replace(part, r"^\s+", ""))
        body = F.replace(F.regexp_replace(part, r"^\s+|\s+$", ""), F.lit(_MARK), F.lit("."))
        return let(body, lambda b: F.struct(b.alias("text"), (start + front).cast("int").alias("start"), (start + front + F.length(b)).cast("int").alias("end")))

    def placed(parts: Column) -> Column:
        return F.filter(F.zip_with(parts, offsets(F.transform(parts, lambda x: F.length(x))), one), lambda s: s["text"] != "")

    return let(F.split(F.regexp_replace(text, ends, f"$1{_CUT}"), _CUT), placed)


def sentences(text: str | Column) -> Column:
    """array<struct<text, start, end>>: ends are ``.?!`` before a capital."""
    col = F.col(text) if isinstance(text, str) else text
    return _sentences(col, "([.?!][)\\]\"'»]*)(?=\\s+[A-ZÄÖÜ])")


def german_sentences(text: str | Column) -> Column:
    """The same for German: full stops of abbreviations and of initials end
    none, and a sentence may begin with a quotation or a number."""
    col = F.col(text) if isinstance(text, str) else text
    return _sentences(_held(col), "([.?!…][)\\]\"'»”]*)(?=\\s+[\"'»„“A-ZÄÖÜ0-9])")
