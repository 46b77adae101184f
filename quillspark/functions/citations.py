"""Citations in running text and their entries in a bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.arrays import let, offsets

# Patterns of names and years.
ET_AL = r"(?:et\.?\s+al\.?|u\.?\s*a\.|e\.?\s*a\.)"
NAME = r"(?:[A-ZÄÖÜ]{2,}|[A-ZÄÖÜ][a-zäöüß][A-ZÄÖÜa-zäöüß'-]*)"
FAMILY = rf"(?:(?:von|de|da|le|la|van|der|den|du|del)\s+)?{NAME}(?:\s+{NAME}){{0,2}}"
AUTHORS = rf"{FAMILY}(?:\s+{ET_AL})?(?:\s*(?:[/&]|\bund\b)\s*{FAMILY})*"
YEAR = r"((?:18|19|20)\d{2})([a-z])?(?:\s*[/-]\s*(?:18|19|20)?\d{2}[a-z]?)?(?:\s*[:,]\s*(?:S\.\s*)?([\dff.,\s–-]+))?"
# Words that are no authors.
NO_AUTHORS = frozenset(
    "Anfang Beginn Ende Mitte Schluss Stand Jahr Tag Monat Woche Stunde Phase Stufe Etappe Periode Zeitraum "
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember "
    "Studie Untersuchung Forschung Analyse Beispiel Kapitel Abschnitt Punkt Teil Vgl Siehe Ebd Hrsg Hg Etc Bzw "
    "Der Die Das Den Dem Des Ein Eine Einer Eines Einem Einen Diese Dieser Dieses Diesen Diesem Jene Jener Jenes Jenen Jenem "
    "Im Am Um In An Auf Über Unter Vor Nach Neben Bei Mit Aus Ohne Durch Für Wegen Und Oder Aber Wenn Weil".split()
)
COUNTED = r"\(([A-ZÄÖÜ][^()]{0,80}?\b\d{4})"
_JOINED = r"\s*(?:[/&]|\bund\b)\s*"
CITATION = "struct<offset:int,raw:string,authors:array<string>,year:string,suffix:string,page:string>"


def n_inline(text: str | Column) -> Column:
    """How many brackets with a name and a year a text has."""
    return F.regexp_count(text, F.lit(COUNTED))


_MARK, _PART = "\x01", "\x02"  # stand around a match and between its groups; no form matches them


def _read(found: Column, at: Column) -> Column:
    """A citation from a match and its groups; null if its first author is none."""
    part = lambda k: F.nullif(F.trim(F.get(found, F.lit(k))), F.lit(""))
    names = F.split(F.regexp_replace(F.regexp_replace(part(1), rf"(?i)\s+{ET_AL}", ""), _JOINED, _MARK), _MARK)

    def made(authors: Column) -> Column:
        odd = F.exists(F.split(F.get(authors, F.lit(0)), r"\s+"), lambda x: x.isin(*sorted(NO_AUTHORS)))
        return F.when(~odd, F.struct(at.cast("int").alias("offset"), F.get(found, F.lit(0)).alias("raw"), authors.alias("authors"), part(2).alias("year"), part(3).alias("suffix"), part(4).alias("page")))

    return let(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""), made)


def _places(text: Column, form: str, groups: int = 0) -> Column:
    """array<struct<found, at>>: the matches of ``form`` in a text, each with its
    first ``groups`` groups, and their places.  One pass marks them all: what
    splits a text by a form reads the form anew for each text."""
    marks = _MARK + _PART.join(f"${k}" for k in range(groups + 1)) + _MARK

    def placed(pieces: Column) -> Column:
        starts = offsets(F.transform(pieces, lambda x: F.length(F.substring_index(x, _PART, 1))))
        own = lambda s: F.transform(pieces, lambda x, k: F.when(k % 2 == 1, F.struct(F.split(x, _PART).alias("found"), F.get(s, k).alias("at"))))
        return F.when(F.size(pieces) > 1, F.filter(let(starts, own), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<found:array<string>,at:bigint>>"))

    return let(F.split(F.regexp_replace(F.translate(text, _MARK + _PART, "\x03\x03"), form, marks), _MARK), placed)


_NARRATIVE = rf"\b({AUTHORS})\s*\(\s*{YEAR}\s*\)"
_INSIDE = rf"\b({AUTHORS}),?\s+{YEAR}"
_YEARS = r"(?:18|19|20)\d{2}"  # a text without one cites nothing
_BRACKETS = r"\([^()]+\)"


def citations_of(text: str | Column) -> Column:
    """array<struct<offset, raw, authors, year, suffix, page>> of a paragraph,
    by offset; the narrative form goes before one in brackets at its place."""
    col = F.col(text) if isinstance(text, str) else text
    known = lambda x: F.filter(x, lambda c: c.isNotNull())
    raw = lambda b: F.get(b["found"], F.lit(0))
    told = F.transform(_places(col, _NARRATIVE, 4), lambda p: _read(p["found"], p["at"]))
    block = lambda b: F.transform(_places(F.substring(raw(b), F.lit(2), F.length(raw(b)) - 2), _INSIDE, 4), lambda p: _read(p["found"], b["at"] + 1 + p["at"]))
    inside = F.flatten(F.transform(F.filter(_places(col, _BRACKETS), lambda b: raw(b).rlike(_YEARS)), block))
    both = let(known(told), lambda t: F.array_sort(F.concat(t, F.filter(known(inside), lambda c: ~F.exists(t, lambda d: d["offset"] == c["offset"])))))
    return F.when(col.rlike(_YEARS), both).otherwise(F.array().cast(f"array<{CITATION}>"))


def mentions(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each author of each citation of the paragraphs."""
    c = paragraphs.withColumn("c", F.explode(citations_of(text))).drop(text)
    return c.select("*", "c.offset", "c.year", "c.suffix", F.explode("c.authors").alias("author")).drop("c")


# Headings of bibliographies.
BIBLIOGRAPHY = r"(?iu)^\s*(literaturverzeichnis|literatur(?:\s+und\s+quellen)?|bibliographie|bibliografie|quellenverzeichnis|quellen|referenzen|references)\s*$"


def bibliography_paragraphs(e: DataFrame) -> DataFrame:
    """Entries (document_id, char_start, content) among elements (document_id,
    char_start, element_type, section_kind, content): the paragraphs of sections
    of that kind; in a document without any, those from the first heading that
    says so to the next heading.  Entries of fewer than five characters go."""
    w = Window.partitionBy("document_id").orderBy("char_start")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    main = (F.col("element_type") == "heading") & (F.col("section_kind") == "main")
    said = main & F.col("content").rlike(BIBLIOGRAPHY)
    own = (F.col("section_kind") == "bibliography") & (F.col("element_type") == "paragraph")
    x = e.withColumn("_own", F.max(own).over(Window.partitionBy("document_id"))).withColumn("_nth", F.sum(said.cast("int")).over(upto))
    x = x.withColumn("_open", F.last(F.when(main, said & (F.col("_nth") == 1)), ignorenulls=True).over(upto))
    keep = F.when(F.col("_own"), own).otherwise(F.coalesce("_open", F.lit(False)) & (F.col("element_type") == "paragraph"))
    return x.where(keep & (F.length(F.trim("content")) >= 5)).select("document_id", "char_start", F.trim("content").alias("content"))


def bibliography_keys(entries: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Entries with first author's last name, year and suffix (null if none)."""
    at = lambda p, k: F.nullif(F.regexp_extract(raw, p, k), F.lit(""))
    year = r"\(?\b((?:18|19|20)\d{2})([a-z])?\b"
    return entries.withColumn("last_name", at(r"^\s*((?:(?:von|de|da|le|la|van|der|den|du|del)\s+)?[\p{Lu}][\p{L}'’-]+)", 1)).withColumn("year", at(year, 1)).withColumn("suffix", at(year, 2))


def resolve(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Citations (citation_id, document_id, author, year, suffix) with the ids
    of their entries (entry_id, document_id, last_name, year, suffix): those of
    the same suffix if there is any, else all of that author and year."""
    keys = ["document_id", "author", "year"]
    e = entries.where("entry_id is not null").select("document_id", F.col("last_name").alias("author"), "year", F.col("suffix").alias("entry_suffix"), "entry_id")
    # the entries of a key once, not once for each citation of it
    alike = e.groupBy(*keys, "entry_suffix").agg(F.collect_set("entry_id").alias("ids"))
    known = alike.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("entry_suffix").isNotNull(), F.struct("entry_suffix", F.array_sort("ids").alias("v"))))).alias("by_suffix"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("any"))
    c = cited.select("citation_id", *keys, "suffix")
    single = c.groupBy("citation_id").agg(F.count("*").alias("_n"), F.first(F.struct(*keys, "suffix")).alias("_c"))
    none = F.array().cast(alike.schema["ids"].dataType)

    def met(x: DataFrame) -> DataFrame:
        same = F.element_at("by_suffix", F.col("suffix"))
        return x.join(known, keys, "left").select("citation_id", F.coalesce(same, none).alias("same"), F.coalesce("any", none).alias("any"))

    one = met(single.where("_n = 1").select("citation_id", "_c.*"))
    # an id of several citations has the entries of all of them
    several = met(c.join(single.where("_n > 1").select(F.col("citation_id").alias("_id")), F.col("citation_id").eqNullSafe(F.col("_id")), "left_semi"))
    merged = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x)
    ids = one.unionByName(several.groupBy("citation_id").agg(merged("same"), merged("any")))
    return ids.select("citation_id", F.when(F.size("same") > 0, F.col("same")).otherwise(F.col("any")).alias("entry_ids"))
