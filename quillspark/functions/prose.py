"""Structured answers of models, read as tables.

An answer is lines; a header line opens a section, a ``key:`` line a field, and
lines after it continue the field.  Argument graphs and assessments are read by
expressions within the row of their answer; ``structured`` takes answers of any
length, as running sums over their lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.arrays import let
from quillspark.sources.tables import lines

FIELD = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:\s*(.*)$"


def _sections(responses: DataFrame, header: Column, boundary: Column) -> DataFrame:
    """Lines below headers: ``section`` (number) and ``head`` (the header line)."""
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = lines(responses, "atom_id", "raw_text").withColumn("content", F.regexp_replace("content", r"\r$", ""))
    e = e.withColumn("_open", boundary).withColumn("section", F.sum(F.col("_open").cast("int")).over(w))
    e = e.withColumn("head", F.last(F.when(F.col("_open"), F.when(header, F.col("content")).otherwise("")), ignorenulls=True).over(w))
    return e.where("not _open and head is not null and head <> ''").drop("_open")


def _joined(by: Sequence[str], value: str = "v") -> Column:
    parts = F.array_sort(F.collect_list(F.struct("seq", value)))
    return F.regexp_replace(F.array_join(F.transform(parts, lambda x: x[value]), "\n"), r"^\s+|\s+$", "")


def fields(s: DataFrame, known: Sequence[str] | None = None) -> DataFrame:
    """(document_id, section, head, key, value) of sections' fields; a line that
    names no (known) field continues the one before."""
    key = F.lower(F.regexp_extract("content", FIELD, 1))
    opens = (key != "") & (key.isin(*known) if known else F.lit(True))
    w = Window.partitionBy("document_id", "section").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    f = s.withColumn("_o", opens).withColumn("field", F.sum(F.col("_o").cast("int")).over(w)).where("field > 0")
    f = f.withColumn("v", F.when(F.col("_o"), F.regexp_extract("content", FIELD, 2)).otherwise(F.col("content"))).withColumn("k", F.when(F.col("_o"), key))
    one = f.groupBy("document_id", "section", "head", "field").agg(F.max("k").alias("key"), _joined(["seq"]).alias("value"))
    last = one.groupBy("document_id", "section", "head", "key").agg(F.max_by("value", "field").alias("value"))
    return last


def structured(responses: DataFrame, singletons: Sequence[str], lists: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, items, failures) of answers (atom_id, raw_text) with ``## NAME``
    and ``## NAME n`` headers.

    values (atom_id, name, value); items (atom_id, name, n, key, value); an
    answer without a known header fails.  Any heading ends a section; a later
    section of the same name or number counts.
    """
    at = lambda k: F.regexp_extract("content", r"^\s*#{1,3}\s+([A-Z][A-Z0-9_]*?)(?:\s+(\d+))?\s*$", k)
    known = F.when(at(2) == "", at(1).isin(*singletons)).otherwise(at(1).isin(*lists) if lists else F.lit(False))
    s = _sections(responses, known & (at(1) != ""), F.col("content").rlike(r"^\s*#{1,6}\s+\S"))
    head = lambda k: F.regexp_extract("head", r"^\s*#{1,3}\s+([A-Z][A-Z0-9_]*?)(?:\s+(\d+))?\s*$", k)
    s = s.withColumn("name", head(1)).withColumn("n", F.nullif(head(2), F.lit("")).cast("int")).withColumn("v", F.col("content"))
    single = s.where("n is null").groupBy("document_id", "section", "name").agg(_joined(["seq"]).alias("value"))
    single = single.groupBy(F.col("document_id").alias("atom_id"), "name").agg(F.max_by("value", "section").alias("value"))
    every = sorted({k for v in lists.values() for k in v})
    f = fields(s.where("n is not null"), every).withColumn("name", head(1)).withColumn("n", head(2).cast("int"))
    items = f.groupBy(F.col("document_id").alias("atom_id"), "name", "n", "key").agg(F.max_by("value", "section").alias("value"))
    ok = F.exists(F.split("raw_text", "\n"), lambda x: F.when(F.regexp_extract(x, r"^\s*#{1,3}\s+([A-Z][A-Z0-9_]*?)(\s+\d+)?\s*$", 2) == "", F.regexp_extract(x, r"^\s*#{1,3}\s+([A-Z][A-Z0-9_]*?)(\s+\d+)?\s*$", 1).isin(*singletons)).otherwise(F.regexp_extract(x, r"^\s*#{1,3}\s+([A-Z][A-Z0-9_]*?)(\s+\d+)?\s*$", 1).isin(*(lists or [""]))))
    return single, items, responses.where(~ok).select("atom_id", F.lit("header-scan").alias("stage"))


_BLANK = r"[ \t\x0B\f\r]"  # white space within a line
_LINE_END = r"(?=\n|\z)"
_HEADER = rf"(?i)\n{_BLANK}*(?:ARGUMENT{_BLANK}+(?=A)|SCAFFOLDING{_BLANK}+(?=S)|(?=EDGES))(A\d+|S\d+|EDGES){_BLANK}*{_LINE_END}"
_KEY = rf"\n{_BLANK}*([A-Za-z_][A-Za-z0-9_]*){_BLANK}*:{_BLANK}*(?=.*{_LINE_END})"
# Kinds of edges, grounding and functions.
_EDGE = r"(?i)^\s*(A\d+)\s*-\s*(supports|refines|contradicts|presupposes)\s*->\s*(A\d+|§\d+:A\d+)\s*$"
GROUNDINGS = ("none", "namedropping", "abstract", "concrete")
FUNCTIONS = ("textorganisatorisch", "didaktisch", "kontextualisierend", "rhetorisch")
_MARK = "\r\n"  # stands nowhere once line ends are plain
_ALL = 1 << 30


def _below(text: Column, form: str, end: str = "") -> Column:
    """array<string>: what follows each match of ``form``, after the first group of
    the match and ``end``.  One pass marks all matches; lines are not looked at singly."""
    return F.slice(F.split(F.regexp_replace(text, form, f"{_MARK}$1{end}"), _MARK), 2, _ALL)


def _row_sections(raw: Column, header: str) -> Column:
    """array<struct<id, text>>: the sections of an answer that have lines, by the name
    in their header; the text has the name as its first line."""
    plain = F.concat(F.lit("\n"), F.when(raw.contains("\r"), F.regexp_replace(raw, r"\r+" + _LINE_END, "")).otherwise(raw))
    return F.transform(F.filter(_below(plain, header), lambda x: x.contains("\n")), lambda x: F.struct(F.upper(F.substring_index(x, "\n", 1)).alias("id"), x.alias("text")))


def _row_fields(text: Column) -> Column:
    """array<struct<key, value>>: the fields of a section in their order."""
    value = lambda x: F.btrim(F.substr(x, F.instr(x, "\n")), F.lit(" \t\n\x0b\f\r"))
    return F.transform(_below(text, _KEY, "\n"), lambda x: F.struct(F.lower(F.substring_index(x, "\n", 1)).alias("key"), value(x).alias("value")))


def _get(found: Column, *names: str) -> Column:
    """The last value of the first of the names that a section has, else ''."""
    last = lambda name: F.try_element_at(F.filter(found, lambda f: f["key"] == name), F.lit(-1))["value"]
    return F.coalesce(*[last(n) for n in names], F.lit(""))


def _first(sections: Column, name: Callable[[Column, Column], Column] = lambda s, k: s["id"]) -> Column:
    """Of sections with the same name the first."""
    keys = lambda own: F.sort_array(F.transform(own, lambda s, k: F.struct(name(s, k).alias("key"), k.alias("k"))))
    firsts = lambda own: let(keys(own), lambda ks: F.transform(F.filter(ks, lambda x, i: (i == 0) | (F.get(ks, i - 1)["key"] != x["key"])), lambda x: F.get(own, x["k"])))
    return F.when(F.size(F.array_distinct(sections["id"])) == F.size(sections), sections).otherwise(let(sections, firsts))


def _read(sections: Column, letter: str, made: Callable[[Column, Column], Column]) -> Column:
    """``made(id, fields)`` of the sections whose ids begin with a letter; without those
    that have no fields, or of which nothing is made."""
    own = F.filter(sections, lambda s: s["id"].startswith(letter))
    return F.filter(F.transform(own, lambda s: let(_row_fields(s["text"]), lambda f: F.when(F.size(f) > 0, made(s["id"], f)))), lambda x: x.isNotNull())


def _arguments(sections: Column, *kept: str) -> Column:
    """array<struct<local_id, claim, anchor_phrase, grounding, premises>> or what is kept of it, also of those without a claim."""

    def made(local: Column, f: Column) -> Column:
        g = F.lower(_get(f, "grounding", "referential_grounding"))
        kind = let(g, lambda x: F.when(x.isin(*GROUNDINGS), x).otherwise("none"))
        every = {"local_id": local, "claim": _get(f, "claim"), "anchor_phrase": _get(f, "anchor", "anchor_phrase"), "grounding": kind, "premises": _get(f, "premises")}
        return F.struct(*[every[k].alias(k) for k in kept or every])

    return _read(sections, "A", made)


def _scaffolding(sections: Column, *kept: str) -> Column:
    """array<struct<local_id, excerpt, function_type, description, assessment, anchored_to, anchor_phrase>> or what is kept of it."""

    def made(local: Column, f: Column) -> Column:
        plain = F.substring(F.trim(F.regexp_replace(_get(f, "excerpt"), "^[\"„](.*)[\"“”]$", "$1")), 1, 1000)
        kind = let(F.lower(_get(f, "function", "function_type")), lambda x: F.when(x.isin(*FUNCTIONS), x).otherwise("kontextualisierend"))
        refs = F.filter(F.transform(F.split(F.translate(_get(f, "anchored_to"), ";", ","), ","), lambda x: F.upper(F.trim(x))), lambda x: x.rlike(r"^(A\d+|§\d+:A\d+)$"))
        every = {
            "local_id": local, "excerpt": plain, "function_type": kind, "description": _get(f, "description", "function_description"),
            "assessment": _get(f, "assessment"), "anchored_to": refs, "anchor_phrase": _get(f, "anchor", "anchor_phrase"),
        }
        whole = (_get(f, "excerpt") != "") & (every["description"] != "") & (every["assessment"] != "")
        return F.when(whole, F.struct(*[every[k].alias(k) for k in kept or every]))

    return _read(sections, "S", made)


_FRONT = r"(?i)^(\s*A\d+\s*-\s*(?:supports|refines|contradicts|presupposes)\s*->\s*)(.+)$"


def _edge_lines(sections: Column) -> Column:
    """array<struct<e, from_id, to_id, k>>: edges as written, one target each; ``k`` is empty if unreadable."""
    rows = F.flatten(F.transform(F.filter(sections, lambda s: s["id"] == "EDGES"), lambda s: F.slice(F.split(s["text"], "\n"), 2, _ALL)))
    bare = lambda x: F.trim(F.when(x.contains("("), F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")).otherwise(x))
    arrow = lambda x: F.replace(F.when(x.contains("-->"), F.regexp_replace(x, "-{1,3}>", "->")).otherwise(x), F.lit("→"), F.lit("->"))
    rows = F.transform(F.filter(F.transform(rows, bare), lambda x: x != ""), arrow)
    targets = lambda x: F.filter(F.split(F.regexp_replace(x, r"\s*,\s*", "\n"), "\n"), lambda y: y != "")
    front = lambda x: F.split(F.regexp_replace(x, _FRONT, "$1\n$2"), "\n")
    single = lambda m, x: F.when(F.get(m, F.lit(1)).contains(","), F.transform(targets(F.get(m, F.lit(1))), lambda y: F.concat(F.get(m, F.lit(0)), y))).otherwise(F.array(x))
    each = F.flatten(F.transform(rows, lambda x: F.when(x.contains(","), let(front(x), lambda m: single(m, x))).otherwise(F.array(x))))
    part = lambda m, k: F.coalesce(F.get(m, F.lit(k)), F.lit(""))
    read = F.transform(each, lambda x: F.struct(x.alias("e"), F.slice(F.split(F.regexp_replace(x, _EDGE, "\n$1\n$3\n$2"), "\n"), 2, 3).alias("m")))
    return F.transform(read, lambda x: F.struct(x["e"].alias("e"), F.upper(part(x["m"], 0)).alias("from_id"), F.upper(part(x["m"], 1)).alias("to_id"), F.lower(part(x["m"], 2)).alias("k")))


def argument_graph(responses: DataFrame) -> dict[str, DataFrame]:
    """Tables ``arguments``, ``premises``, ``edges``, ``scaffolding`` and
    ``warnings`` of answers (atom_id, raw_text), and ``rows``: (atom_id,
    arguments, edges, scaffolding) with what a graph needs of an answer in one row.

    An answer is read within its row, so nothing is shuffled; it is known by its
    ``atom_id``.
    """
    s = responses.select("atom_id", _row_sections(F.col("raw_text"), _HEADER).alias("s"))
    own = lambda s, k: F.when(s["id"] == "EDGES", F.concat(s["id"], k.cast("string"))).otherwise(s["id"])
    s = s.select("atom_id", _first(F.col("s"), own).alias("s"))
    claimed = lambda *kept: F.filter(_arguments(F.col("s"), *kept), lambda x: x["claim"] != "")
    made = claimed()
    each = lambda column, name: s.select("atom_id", F.inline(column)) if name is None else s.select("atom_id", F.explode(column).alias(name))
    args = each(made, None)

    form = r"(?i)^\s*(stated|carried|background)\b(?:\s*§\s*(\d+))?\s*:\s*(.+)$"
    p = F.flatten(F.transform(made, lambda a: F.transform(F.split(a["premises"], "\n"), lambda x, n: F.struct(a["local_id"].alias("local_id"), n.alias("n"), x.alias("p")))))
    p = each(F.transform(F.filter(p, lambda x: F.trim(x["p"]) != ""), lambda x: F.struct(x["local_id"], x["n"], F.regexp_replace(x["p"], r"^\s*-\s+", "").alias("p"))), None)
    kind = F.lower(F.regexp_extract("p", form, 1))
    premises = p.select("atom_id", "local_id", "n", F.when(kind == "", "stated").otherwise(kind).alias("type"), F.trim(F.when(kind == "", F.col("p")).otherwise(F.regexp_extract("p", form, 3))).alias("text"), F.nullif(F.regexp_extract("p", form, 2), F.lit("")).cast("int").alias("from_paragraph"))

    inner = lambda x: ~x["to_id"].startswith("§")
    demoted = lambda x: inner(x) & (x["k"] == "presupposes")
    good = lambda x: (x["k"] != "") & ~x["to_id"].startswith("§0:")
    edge = lambda x: F.struct(x["from_id"].alias("from_id"), x["to_id"].alias("to_id"), F.when(demoted(x), "supports").otherwise(x["k"]).alias("kind"), F.when(inner(x), "inter_argument").otherwise("prior_paragraph").alias("scope"))
    edges = F.transform(F.filter(_edge_lines(F.col("s")), good), edge)

    what = lambda x: F.when(x["k"] == "", "unreadable edge").when(demoted(x), "presupposes made supports").otherwise("no paragraph 0")
    odd = F.transform(F.filter(_edge_lines(F.col("s")), lambda x: ~good(x) | demoted(x)), lambda x: F.struct(what(x).alias("what"), x["e"].alias("at")))
    lost = F.transform(F.filter(_arguments(F.col("s")), lambda x: x["claim"] == ""), lambda x: F.struct(F.lit("no claim").alias("what"), x["local_id"].alias("at")))
    return {
        "arguments": args.drop("premises"), "premises": premises, "edges": each(edges, None), "scaffolding": each(_scaffolding(F.col("s")), None), "warnings": each(F.concat(odd, lost), None),
        "rows": s.select("atom_id", claimed("local_id", "claim", "anchor_phrase", "grounding").alias("arguments"), edges.alias("edges"), _scaffolding(F.col("s"), "local_id", "anchored_to").alias("scaffolding")),
    }


def json_object(text: Column, schema: str) -> Column:
    """The object in an answer: first brace to last, typographic quotes
    repaired if it does not parse otherwise; null if neither does."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(body, "[„“”]", '"')
    return F.from_json(F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(fixed).isNotNull(), fixed), schema)


FORMS = ("deductive", "inductive", "abductive")


def validity(responses: DataFrame, arguments: DataFrame, fallacies: Sequence[str]) -> DataFrame:
    """Assessments (atom_id, local_id, carries, form, fallacy, target,
    rationale) of answers (atom_id, raw_text) with ``VALIDITY An`` sections, for
    known arguments (atom_id, local_id): one that carries needs a form, one that
    does not a known fallacy and a target, both a rationale."""
    form = rf"(?i)\n{_BLANK}*(?:#{{1,3}}{_BLANK}+)?[*_]{{0,3}}{_BLANK}*VALIDITY{_BLANK}+(A\d+){_BLANK}*[*_]{{0,3}}{_BLANK}*{_LINE_END}"
    get = lambda f, *names: F.trim(_get(f, *names))

    def last(found: Column) -> Column:
        """Of sections of the same argument the last that has fields."""
        return _first(F.reverse(F.filter(found, lambda x: F.size(x["f"]) > 0)))

    read = F.transform(_row_sections(F.col("raw_text"), form), lambda s: F.struct(s["id"], _row_fields(s["text"]).alias("f")))
    known = arguments.groupBy("atom_id").agg(F.collect_set("local_id").alias("known"))
    both = responses.select("atom_id", "raw_text").join(known, "atom_id").select("atom_id", F.explode(let(read, last)).alias("x"), "known")
    f = F.col("x.f")
    w = both.where(F.array_contains("known", F.col("x.id"))).select("atom_id", F.col("x.id").alias("local_id"), F.lower(get(f, "carries")).isin("yes", "true").alias("carries"), F.lower(get(f, "form", "inference_form")).alias("form"), F.lower(get(f, "fallacy")).alias("fallacy"), get(f, "target", "target_premise").alias("target"), get(f, "rationale").alias("rationale"))
    w = w.withColumn("form", F.when(F.col("form").isin(*FORMS), F.col("form")))
    ok = (F.col("rationale") != "") & F.when(F.col("carries"), F.col("form").isNotNull()).otherwise(F.col("fallacy").isin(*fallacies) & (F.col("target") != ""))
    return w.where(ok).withColumn("fallacy", F.when(~F.col("carries"), F.col("fallacy"))).withColumn("target", F.when(~F.col("carries"), F.col("target")))
