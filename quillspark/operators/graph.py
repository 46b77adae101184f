"""Argument graphs and work lists as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import let
from quillspark.sources.folders import written

_REFERENCE = r"^\s*(?:§(\d+):)?(A\d+)\s*$"  # an argument of this paragraph or of another one


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, other, direction): every edge seen from both ends."""
    out = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), F.lit("in").alias("direction")))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def candidate_score(grounding: Column, cited: Column, degree: Column, most: int = 4) -> Column:
    return (grounding + cited.cast("int") + F.least(degree, F.lit(most))).cast("int")


def preflight(work: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """(phase, total, done, pending) of work (id, phase)."""
    marks = work.join(done.distinct().withColumn("d", F.lit(True)), "id", "left").join(failed.distinct().withColumn("f", F.lit(True)), "id", "left")
    return marks.groupBy("phase").agg(F.count("*").alias("total"), F.count_if(F.col("d").isNotNull()).alias("done"), F.count_if(F.col("d").isNull() & F.col("f").isNull()).alias("pending"))


def resolve_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Textual references (unit, position, ref) like ``A3`` or ``§2:A1`` to node
    ids: (unit, position, ref, node_id, reason); nodes (unit, position,
    local_id, node_id).  What can't be resolved has a reason."""
    m = lambda k: F.regexp_extract("ref", _REFERENCE, k)
    r = refs.withColumn("local_id", m(2)).withColumn("at", F.when(m(1) != "", m(1).cast("int")).otherwise(F.col("position")))
    n = nodes.withColumnRenamed("position", "at")
    reason = F.when(F.col("local_id") == "", "unreadable").when(F.col("at") == 0, "no such paragraph").when(F.col("node_id").isNull(), "no such argument")
    return r.join(n, ["unit", "at", "local_id"], "left").select("unit", "position", "ref", "node_id", reason.alias("reason"))


def anchor_spans(nodes: DataFrame) -> DataFrame:
    """Spans of anchor phrases in paragraph texts (text, char_start, phrase):
    the first place of the phrase, else the whole paragraph."""
    at = F.expr("instr(text, phrase)")
    found = (at > 0) & (F.length("phrase") > 0)
    start = F.when(found, F.col("char_start") + at - 1).otherwise(F.col("char_start"))
    size = F.when(found, F.length("phrase")).otherwise(F.length("text"))
    return nodes.withColumn("anchor_start", start).withColumn("anchor_end", F.col("anchor_start") + size)


def anchor_labels(anchors: DataFrame) -> DataFrame:
    """Anchors (unit, position, local_id, at) with their ``label``: the local id,
    with the paragraph's number before it if that is another one (``at``)."""
    other = F.col("at").isNotNull() & (F.col("at") != F.col("position"))
    return anchors.withColumn("label", F.when(other, F.concat(F.lit("§"), F.col("at").cast("string"), F.lit(":"), F.col("local_id"))).otherwise(F.col("local_id")))


def _node_id(unit: Column | str, at: Column | str, local: Column | str) -> Column:
    return F.concat_ws("/", unit, F.col(at).cast("string") if isinstance(at, str) else at.cast("string"), local)


def _found(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (unit, refs: array<struct<ref, at, local_id, ...>>, and more) one
    each, with node_id and reason; known has (unit, at, ids).  Those of a row to the
    same paragraph meet it together."""
    ats = F.array_distinct(F.transform("refs", lambda r: r["at"]))
    r = refs.select("*", F.explode(ats).alias("at")).withColumn("refs", F.filter("refs", lambda x: x["at"] == F.col("at")))
    j = r.join(known, ["unit", "at"], "left").select(*[c for c in refs.columns if c != "refs"], "at", "ids", F.explode("refs").alias("r"))
    there = F.coalesce(F.array_contains("ids", F.col("r.local_id")), F.lit(False))
    reason = F.when(F.col("r.ref").isNull(), "nothing found").when(F.col("r.local_id") == "", "unreadable").when(F.col("at") == 0, "no such paragraph").when(~there, "no such argument")
    return j.select(*[c for c in j.columns if c not in ("at", "ids", "r")], "r.*", F.when(there, _node_id("unit", "at", "r.local_id")).alias("node_id"), reason.alias("reason"))


def stored_nodes(tables: dict[str, DataFrame], paragraphs: DataFrame) -> DataFrame:
    """Arguments of paragraphs (as in ``stored_graph``) with ids and anchors, in one pass."""
    own = tables["rows"].join(paragraphs.select("atom_id", "unit", "position", "text", "char_start"), "atom_id")
    a = own.select("atom_id", "unit", "position", "text", "char_start", F.inline(F.transform("arguments", lambda x: F.struct(x["local_id"].alias("local_id"), x["claim"].alias("claim"), x["anchor_phrase"].alias("phrase"), x["grounding"].alias("grounding")))))
    return anchor_spans(a).select(_node_id("unit", "position", "local_id").alias("node_id"), "atom_id", "unit", "position", "local_id", "claim", "grounding", "anchor_start", "anchor_end")


_LINKED = "filter(edges, x -> array_contains(ids, x.from_id))"  # edges that begin at an argument


def _reference(ref: Column, **more: Column) -> Column:
    m = lambda k: F.regexp_extract(ref, _REFERENCE, k)
    far = lambda k: F.when(k != "", k.cast("int")).otherwise(F.col("position"))
    at = F.when(ref.contains("§"), let(m(1), far)).otherwise(F.col("position"))
    return F.struct(ref.alias("ref"), at.alias("at"), m(2).alias("local_id"), *[v.alias(k) for k, v in more.items()])


def _edge_references() -> Column:
    return F.transform(F.expr(_LINKED), lambda x: _reference(x["to_id"], from_id=x["from_id"], kind=x["kind"], scope=x["scope"]))


def _anchored(made: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform("scaffolding", lambda s: F.transform(s["anchored_to"], lambda r: made(s, r))))


def _places(tables: dict[str, DataFrame], paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with their local ids, groundings, edges and scaffolding."""
    each = lambda name: F.transform("arguments", lambda x: x[name])
    places = tables["rows"].join(paragraphs.select("atom_id", "unit", "position"), "atom_id", "right")
    return places.select("atom_id", "unit", "position", each("local_id").alias("ids"), each("grounding").alias("groundings"), "edges", "scaffolding")


def linked_nodes(tables: dict[str, DataFrame], paragraphs: DataFrame) -> DataFrame:
    """Arguments of paragraphs (as in ``stored_graph``) with what they are tied to:
    (unit, position, local_id, node_id, grounding, degree, held), held if scaffolding
    stands on them.

    References to their own paragraph are counted within its row, before rows are
    written; only those to another one meet the local ids there.
    """
    own = lambda r: r["at"] == F.col("position")
    away = lambda refs, begins: F.transform(F.filter(refs, lambda r: ~own(r)), lambda r: F.struct(r["at"].cast("long").alias("at"), r["local_id"].alias("local_id"), begins(r).alias("from_id")))
    p = _places(tables, paragraphs).where("unit is not null")
    p = p.select("unit", "position", "ids", "groundings", _edge_references().alias("links"), F.array_distinct(_anchored(lambda s, r: _reference(r))).alias("anchors"))

    within = F.filter("links", lambda r: own(r) & F.array_contains("ids", r["local_id"]))
    ends = F.concat(F.transform(within, lambda r: r["from_id"]), F.transform(within, lambda r: r["local_id"]))
    below = F.transform(F.filter("anchors", own), lambda r: r["local_id"])
    counted = lambda tied, held: F.transform("ids", lambda i, k: F.struct(i.alias("local_id"), F.get("groundings", k).alias("grounding"), F.size(F.filter(tied, lambda x: x == i)).cast("long").alias("degree"), F.array_contains(held, i).alias("held")))
    nodes = let(F.struct(ends.alias("ends"), below.alias("below")), lambda x: counted(x["ends"], x["below"]))
    far = F.concat(away("links", lambda r: r["from_id"]), away("anchors", lambda r: F.lit(None).cast("string")))
    p = written(p.select("unit", F.col("position").cast("long").alias("position"), nodes.alias("nodes"), far.alias("far")), "nodes")

    known = p.where(F.size("nodes") > 0).select("unit", F.col("position").alias("at"), F.col("nodes.local_id").alias("ids"))
    met = p.select("unit", "position", F.inline("far")).join(known, ["unit", "at"]).where(F.array_contains("ids", F.col("local_id")))
    held = F.col("from_id").isNull()
    end = lambda at, local, degree, on: F.struct(F.col(at).alias("position"), F.col(local).alias("local_id"), F.lit(None).cast("string").alias("grounding"), degree.cast("long").alias("degree"), on.alias("held"))
    both = F.array(end("at", "local_id", ~held, held), end("position", "from_id", F.lit(1), F.lit(False)))
    tied = met.select("unit", F.inline(F.filter(both, lambda x: x["local_id"].isNotNull())))

    every = p.select("unit", "position", F.inline("nodes")).unionByName(tied).repartition("unit").groupBy("unit", "position", "local_id")
    n = every.agg(F.max("grounding").alias("grounding"), F.sum("degree").alias("degree"), F.max("held").alias("held"))
    return n.withColumn("node_id", _node_id("unit", "position", "local_id"))


def stored_graph(tables: dict[str, DataFrame], paragraphs: DataFrame) -> dict[str, DataFrame]:
    """Rows to store of an argument graph (``prose.argument_graph``) for paragraphs
    (atom_id, unit, position, text, char_start): ``nodes`` with ids and anchors,
    ``edges`` between node ids, ``anchors`` of scaffolding, and ``errors``:
    references that lead nowhere, and paragraphs with nothing.

    Answers meet their paragraphs whole, a row each, and these rows are written to
    the shared folder, so that answers are read once; a reference then meets the
    local ids of the paragraph that it names.
    """
    nodes = stored_nodes(tables, paragraphs)
    places = written(_places(tables, paragraphs).drop("groundings"), "places")
    known = places.where(F.size("ids") > 0).select("unit", F.col("position").alias("at"), "ids")
    none = F.lit(None).cast("string")
    bare = F.when(F.coalesce(F.size("ids") == 0, F.lit(True)) & F.coalesce(F.size("scaffolding") == 0, F.lit(True)), F.array(F.struct(none.alias("ref"), F.col("position").alias("at"), none.alias("local_id"))))
    empty = F.expr("filter(array(named_struct('ref', '', 'at', position, 'local_id', '')), x -> false)")
    every = F.concat(F.coalesce(F.transform(F.expr(_LINKED), lambda x: _reference(x["to_id"])), empty), F.coalesce(_anchored(lambda s, r: _reference(r)), empty), F.coalesce(bare, empty))

    e = _found(places.select("unit", "position", _edge_references().alias("refs")), known).where("node_id is not null")
    s = _found(places.select("atom_id", "unit", _anchored(lambda s, r: _reference(r, scaffold=s["local_id"])).alias("refs")), known).where("node_id is not null")
    lost = _found(places.select("atom_id", "unit", every.alias("refs")), known).where("node_id is null")
    return {
        "nodes": nodes, "edges": e.select("unit", _node_id("unit", "position", "from_id").alias("from_node"), F.col("node_id").alias("to_node"), "kind", "scope"),
        "anchors": s.select("unit", "atom_id", "scaffold", "node_id"), "errors": lost.select("atom_id", F.col("ref").alias("at"), "reason"),
    }
