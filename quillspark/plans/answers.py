"""Answers of models read back: the texts are written by Spark from orders and
their items, parsed, and compared with what SQL reads from the tables directly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import prose
from quillspark.functions.arrays import let
from quillspark.operators import graph, review
from quillspark.registry import query
from quillspark.sources.tables import table

#: One row for each order and line: the first of those that repeat.
I = """i AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::INTEGER AS q, round(l_discount * 100)::INTEGER AS d, l_returnflag AS f FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount) = 1)"""


def _items(spark: SparkSession, folder: str) -> DataFrame:
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")).alias("r")
    r = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(first)
    return r.select("o", "n", F.col("r.l_partkey").alias("p"), F.col("r.l_suppkey").alias("s"), F.col("r.l_quantity").cast("int").alias("q"), F.round(F.col("r.l_discount") * 100).cast("int").alias("d"), F.col("r.l_returnflag").alias("f"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """(atom_id, items): the items of each order by their line, the first of
    those that repeat.  All that follows stays where one shuffle has put it."""
    r = table(spark, folder, "lineitem").select(_text("o", F.col("l_orderkey")).alias("atom_id"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_quantity", "l_discount", F.col("l_returnflag").alias("f")).alias("x"))
    i = r.repartition("atom_id").groupBy("atom_id").agg(F.sort_array(F.collect_list("x")).alias("i"))
    one = let(F.col("i"), lambda own: F.filter(own, lambda x, k: (k == 0) | ~x["n"].eqNullSafe(F.get(own, k - 1)["n"])))
    return i.select("atom_id", F.transform(one, lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p"), x["s"].alias("s"), x["l_quantity"].cast("int").alias("q"), F.round(x["l_discount"] * 100).cast("int").alias("d"), x["f"].alias("f"))).alias("items"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """(atom_id, raw_text): an argument for each item of an order, without claim
    below five pieces; edges by the flag of the item; scaffolding by its discount."""

    def argument(x: Column) -> Column:
        claim = F.when(x.q >= 5, _text("claim: part ", x.p, "\n goes on\n")).otherwise("claim:\n")
        grounding = F.when(x.f == "R", "concrete").when(x.f == "A", "Abstract").otherwise("unheard of")
        return _text("ARGUMENT A", x.n, "\n", claim, "premises:\n- stated: q", x.q, "\n- carried §", x.n, ": s", x.s, "\n- odd one\nanchor: p", x.n, "\ngrounding: ", grounding)

    def edge(x: Column) -> Column:
        n = x.n
        return F.when(n > 1, F.when(x.f == "R", _text("A", n, " -supports-> A1")).when(x.f == "A", _text("A", n, " -refines-> §0:A1")).otherwise(_text("A", n, " -presupposes--> A1, A", n - 1))).otherwise("A1 -contradicts-> §1:A1")

    def scaffold(x: Column) -> Column:
        return F.when(x.d > 5, _text("SCAFFOLDING S", x.n, '\nexcerpt: "e', x.p, '"\nfunction: ', F.when(x.f == "N", "didaktisch").otherwise("new"), "\ndescription: d", x.q, "\nassessment: a\nanchored_to: A", x.n, ", §2:A1; what"))

    return _orders(spark, folder).select("atom_id", _text("In front.\n", _lines("items", argument), "\nEDGES\n", _lines("items", edge), "\n", _lines("items", scaffold)).alias("raw_text"))


def _lines(items: str, said: Callable[[Column], Column]) -> Column:
    """What is said of each item, one under another."""
    return F.array_join(F.filter(F.transform(items, said), lambda x: x.isNotNull()), "\n")


_ARGUMENTS = f"""{I}, a AS (SELECT 'o' || o AS atom_id, o, n, 'A' || n AS local_id, p, s, q, f FROM i WHERE q >= 5)"""
_EDGES = f"""{I}, x AS (
  SELECT o, n, 'A' || n AS from_id, 'A1' AS to_id, 'supports' AS kind FROM i WHERE n > 1 AND f = 'R' UNION ALL SELECT o, n, 'A' || n, unnest(['A1', 'A' || (n - 1)]), 'supports' FROM i WHERE n > 1 AND f NOT IN ('R', 'A') UNION ALL SELECT o, n, 'A1', '§1:A1', 'contradicts' FROM i WHERE n = 1)"""


@query(f"""WITH {_ARGUMENTS} SELECT atom_id, local_id, 'part ' || p || chr(10) || ' goes on' AS claim, 'p' || n AS anchor_phrase, CASE f WHEN 'R' THEN 'concrete' WHEN 'A' THEN 'abstract' ELSE 'none' END AS grounding FROM a""")
def answered_arguments(spark: SparkSession, folder: str) -> DataFrame:
    return prose.argument_graph(_answers(spark, folder))["arguments"]


@query(f"""WITH {_ARGUMENTS} SELECT atom_id, local_id, 0 AS n, 'stated' AS type, 'q' || q AS text, NULL::INTEGER AS from_paragraph FROM a UNION ALL SELECT atom_id, local_id, 1, 'carried', 's' || s, n FROM a UNION ALL SELECT atom_id, local_id, 2, 'stated', 'odd one', NULL FROM a""")
def answered_premises(spark: SparkSession, folder: str) -> DataFrame:
    return prose.argument_graph(_answers(spark, folder))["premises"]


@query(f"""WITH {_EDGES} SELECT 'o' || o AS atom_id, from_id, to_id, kind, CASE WHEN to_id LIKE '§%' THEN 'prior_paragraph' ELSE 'inter_argument' END AS scope FROM x""")
def answered_edges(spark: SparkSession, folder: str) -> DataFrame:
    return prose.argument_graph(_answers(spark, folder))["edges"]


@query(f"""WITH {I} SELECT 'o' || o AS atom_id, 'S' || n AS local_id, 'e' || p AS excerpt, CASE WHEN f = 'N' THEN 'didaktisch' ELSE 'kontextualisierend' END AS function_type, 'd' || q AS description, 'A' || n || ' §2:A1' AS anchored FROM i WHERE d > 5""")
def answered_scaffolding(spark: SparkSession, folder: str) -> DataFrame:
    s = prose.argument_graph(_answers(spark, folder))["scaffolding"]
    return s.select("atom_id", "local_id", "excerpt", "function_type", "description", F.array_join("anchored_to", " ").alias("anchored"))


@query(f"""WITH {I}, w AS (SELECT o, 'no claim' AS what FROM i WHERE q < 5 UNION ALL SELECT o, 'no paragraph 0' FROM i WHERE n > 1 AND f = 'A' UNION ALL SELECT o, unnest(['presupposes made supports', 'presupposes made supports']) FROM i WHERE n > 1 AND f NOT IN ('R', 'A'))
SELECT 'o' || o AS atom_id, what, count(*) AS n FROM w GROUP BY ALL""")
def answer_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return prose.argument_graph(_answers(spark, folder))["warnings"].groupBy("atom_id", "what").agg(F.count("*").alias("n"))


# stored graphs: customers are units, their orders paragraphs


def _graphs(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    orders = table(spark, folder, "orders").select(_text("o", F.col("o_orderkey")).alias("atom_id"), _text("c", F.col("o_custkey")).alias("unit"), "o_orderkey", "o_custkey")
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = orders.withColumn("position", position).select("atom_id", "unit", "position", _text("See p1, then p3 of ", F.col("o_orderkey"), ".").alias("text"), (F.col("position") * 100).cast("long").alias("char_start"))
    return prose.argument_graph(_answers(spark, folder)), p


def _stored(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return graph.stored_graph(*_graphs(spark, folder))


_PLACES = """w AS (SELECT o_orderkey AS o, 'c' || o_custkey AS unit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, 'See p1, then p3 of ' || o_orderkey || '.' AS text FROM orders),
k AS (SELECT unit, pos, 'A' || n AS local, unit || '/' || pos || '/A' || n AS id, i.n, w.text FROM i JOIN w ON w.o = i.o WHERE q >= 5)"""
_TARGET = "JOIN w ON w.o = x.o JOIN k a ON a.unit = w.unit AND a.pos = w.pos AND a.local = x.from_id LEFT JOIN k b ON b.unit = w.unit AND b.pos = CASE WHEN x.to_id LIKE '§1:%' THEN 1 ELSE w.pos END AND b.local = regexp_extract(x.to_id, 'A\\d+$')"
_REFS = f"r AS (SELECT o, n, 'A' || n AS ref, 'A' || n AS local, NULL::BIGINT AS far FROM i WHERE d > 5 UNION ALL SELECT o, n, '§2:A1', 'A1', 2 FROM i WHERE d > 5), t AS (SELECT r.o, r.n, r.ref, w.unit, b.id FROM r JOIN w ON w.o = r.o LEFT JOIN k b ON b.unit = w.unit AND b.pos = coalesce(r.far, w.pos) AND b.local = r.local)"


@query(f"""WITH {I}, {_PLACES} SELECT id AS node_id, (pos * 100 + CASE WHEN contains(text, 'p' || n) THEN instr(text, 'p' || n) - 1 ELSE 0 END)::BIGINT AS anchor_start, (pos * 100 + CASE WHEN contains(text, 'p' || n) THEN instr(text, 'p' || n) - 1 + length('p' || n) ELSE length(text) END)::BIGINT AS anchor_end FROM k""")
def stored_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments with their ids, and the spans of the phrases they stand on."""
    return graph.stored_nodes(*_graphs(spark, folder)).select("node_id", F.col("anchor_start").cast("long").alias("anchor_start"), F.col("anchor_end").cast("long").alias("anchor_end"))


@query(f"""WITH {_EDGES}, {_PLACES} SELECT a.id AS from_node, b.id AS to_node, x.kind FROM x {_TARGET} WHERE b.id IS NOT NULL""")
def stored_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder)["edges"].select("from_node", "to_node", "kind")


@query(f"""WITH {I}, {_PLACES}, {_REFS} SELECT 'o' || o AS atom_id, 'S' || n AS scaffold, id AS node_id FROM t WHERE id IS NOT NULL""")
def stored_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder)["anchors"].select("atom_id", "scaffold", "node_id")


@query(f"""WITH {_EDGES}, {_PLACES}, {_REFS}, e AS (SELECT 'o' || x.o AS atom_id, x.to_id AS "at", 'no such argument' AS reason FROM x {_TARGET} WHERE b.id IS NULL UNION ALL SELECT 'o' || o, ref, 'no such argument' FROM t WHERE id IS NULL
  UNION ALL SELECT 'o' || o, NULL, 'nothing found' FROM w WHERE o NOT IN (SELECT o FROM i WHERE q >= 5 OR d > 5)) SELECT atom_id, "at", reason, count(*) AS n FROM e GROUP BY ALL""")
def store_errors(spark: SparkSession, folder: str) -> DataFrame:
    """References that lead nowhere, and paragraphs in which nothing was found."""
    return _stored(spark, folder)["errors"].groupBy("atom_id", "at", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {I}, r AS (SELECT o, n, CASE n % 5 WHEN 0 THEN 'A' || (n - 1) WHEN 1 THEN ' §2:A1 ' WHEN 2 THEN '?' WHEN 3 THEN '§0:A1' ELSE 'A99' END AS ref FROM i)
SELECT r.o AS unit, r.n AS position, r.ref, CASE WHEN n % 5 = 0 THEN (SELECT max(k.p) FROM i k WHERE k.o = r.o AND k.n = r.n AND 'A' || (r.n - 1) = 'A' || (k.n - 1)) WHEN n % 5 = 1 THEN (SELECT max(k.p) FROM i k WHERE k.o = r.o AND k.n = 2 AND k.n - 1 = 1) END AS node_id,
  CASE n % 5 WHEN 2 THEN 'unreadable' WHEN 3 THEN 'no such paragraph' WHEN 4 THEN 'no such argument' WHEN 1 THEN CASE WHEN NOT EXISTS (SELECT 1 FROM i k WHERE k.o = r.o AND k.n = 2) THEN 'no such argument' END END AS reason FROM r""")
def references_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """References as text resolved to nodes of their unit, or why they can't be:
    the node of position n is there called A(n - 1)."""
    i = _items(spark, folder)
    n = F.col("n")
    ref = F.when(n % 5 == 0, _text("A", n - 1)).when(n % 5 == 1, " §2:A1 ").when(n % 5 == 2, "?").when(n % 5 == 3, "§0:A1").otherwise("A99")
    refs = i.select(F.col("o").alias("unit"), n.alias("position"), ref.alias("ref"))
    nodes = i.select(F.col("o").alias("unit"), n.alias("position"), _text("A", n - 1).alias("local_id"), F.col("p").alias("node_id"))
    return graph.resolve_references(refs, nodes)


@query(f"""WITH {I} SELECT o AS unit, n AS position, 'A' || n AS local_id, CASE WHEN q % 8 NOT IN (0, n) THEN '§' || q % 8 || ':A' || n ELSE 'A' || n END AS label FROM i""")
def anchor_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of anchors, with the paragraph where it is another one."""
    i = _items(spark, folder)
    at = F.when(F.col("q") % 8 != 0, F.col("q") % 8)
    return graph.anchor_labels(i.select(F.col("o").alias("unit"), F.col("n").alias("position"), _text("A", F.col("n")).alias("local_id"), at.alias("at"))).drop("at")


# other forms of answers


@query("""WITH s AS (SELECT s_nationkey AS k, s_suppkey AS n, s_name, floor(s_acctbal)::INTEGER AS b FROM supplier)
SELECT 'n' || n_nationkey AS atom_id, 'value' AS part, 'SUMMARY' AS name, NULL::INTEGER AS n, NULL AS key, n_name || chr(10) || 'second line' AS value FROM nation WHERE n_regionkey <> 3
UNION ALL SELECT 'n' || k, 'item', 'POINT', s.n, 'text', s_name FROM s JOIN nation ON n_nationkey = k WHERE n_regionkey <> 3
UNION ALL SELECT 'n' || k, 'item', 'POINT', s.n, 'note', 'a ' || b || chr(10) || ' b' FROM s JOIN nation ON n_nationkey = k WHERE n_regionkey <> 3
UNION ALL SELECT 'n' || n_nationkey, 'failure', 'header-scan', NULL, NULL, NULL FROM nation WHERE n_regionkey = 3""")
def structured_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and numbered items of answers, and the answers without any."""
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    point = _text("## POINT ", F.col("s_suppkey"), "\ntext: ", F.col("s_name"), "\nnote:\n a ", F.floor("s_acctbal").cast("int"), "\n b")
    points = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", point.alias("t")))), lambda x: x.t), "\n").alias("points"))
    raw = _text("before\n# SUMMARY\n", F.col("n_name"), "\nsecond line\n", F.coalesce("points", F.lit("")), "\n### Other\nlost")
    answers = nation.join(points, "n_nationkey", "left").select(_text("n", F.col("n_nationkey")).alias("atom_id"), F.when(F.col("n_regionkey") == 3, "nothing of it").otherwise(raw).alias("raw_text"))
    one, items, bad = prose.structured(answers, ["SUMMARY"], {"POINT": ["text", "note"]})
    none = lambda t: F.lit(None).cast(t)
    out = one.select("atom_id", F.lit("value").alias("part"), "name", none("int").alias("n"), none("string").alias("key"), "value")
    out = out.unionByName(items.select("atom_id", F.lit("item").alias("part"), "name", "n", "key", "value"))
    return out.unionByName(bad.select("atom_id", F.lit("failure").alias("part"), F.col("stage").alias("name"), none("int").alias("n"), none("string").alias("key"), none("string").alias("value")))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN json_extract(props, '$.k')::INTEGER END AS k, CASE WHEN event_type IN ('view', 'click') THEN event_type || '+' || user_id END AS markers FROM events""")
def json_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Objects in answers: amid words, with typographic quotes, none, and broken
    ones; an array of strings from one of their members."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    whole = _text('say {"k": ', k, ', "marker_names": ["', kind, '", "', F.col("user_id"), '"]} now')
    raw = F.when(kind == "view", whole).when(kind == "click", F.translate(whole, '"', "“")).when(kind == "purchase", _text('{„k“: ', k, "}")).when(kind == "error", "none at all").otherwise('{broken: "')
    j = table(spark, folder, "events").select("event_id", prose.json_object(raw, "k int, marker_names array<string>").alias("j"))
    return j.select("event_id", "j.k", F.when(F.col("j.marker_names").isNotNull(), F.array_join("j.marker_names", "+")).alias("markers"))


@query(f"""WITH {I} SELECT 'o' || o AS atom_id, 'A' || n AS local_id, f = 'R' AS carries, CASE WHEN f = 'R' THEN CASE WHEN q % 2 = 0 THEN 'inductive' ELSE 'deductive' END END AS form, CASE WHEN f <> 'R' THEN 'circular' END AS fallacy, CASE WHEN f <> 'R' THEN 'p' || p END AS target, 'r' || q || chr(10) || ' more' AS rationale
FROM i WHERE n <= 4 AND (f = 'R' AND d <> 3 OR f = 'A')""")
def answered_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Assessments of known arguments; those without a form or with an unknown
    fallacy are left out, and so are those of arguments that there are not."""

    def part(x: Column) -> Column:
        even = x.q % 2 == 0
        yes = _text("carries: yes\nform: ", F.when(x.d == 3, "guess").when(even, "inductive").otherwise("Deductive"))
        no = _text("carries: no\nfallacy: ", F.when(x.f == "A", "circular").otherwise("unknown"), "\ntarget: p", x.p)
        return _text(F.when(even, "## ").otherwise("**"), "VALIDITY A", x.n, F.when(even, "").otherwise("**"), "\n", F.when(x.f == "R", yes).otherwise(no), "\nrationale: r", x.q, "\n more")

    raw = _orders(spark, folder).select("atom_id", _lines("items", part).alias("raw_text"))
    known = table(spark, folder, "lineitem").where("l_linenumber <= 4").select(_text("o", F.col("l_orderkey")).alias("atom_id"), _text("A", F.col("l_linenumber")).alias("local_id"))
    return prose.validity(raw, known.repartition("atom_id"), ["circular"])


@query(f"""WITH {I}, c AS (SELECT o, p, row_number() OVER (PARTITION BY o ORDER BY n) AS rank FROM i) SELECT i.o AS unit, c.rank::INTEGER AS rank, c.p AS node_id, 'd' || d AS rationale FROM i JOIN c ON c.o = i.o AND c.rank = i.q % 4 WHERE i.q % 4 > 0""")
def answers_by_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that name a candidate by its rank."""
    i = _items(spark, folder)
    c = i.select(F.col("o").alias("unit"), F.row_number().over(Window.partitionBy("o").orderBy("n")).alias("rank"), F.col("p").alias("node_id"))
    number = F.when(F.col("q") % 4 == 0, "none").otherwise(_text("Nr. ", F.col("q") % 4))
    return review.by_rank(i.select(F.col("o").alias("unit"), number.alias("number"), _text(" d", F.col("d"), " ").alias("rationale")), c)


@query(f"""WITH {I}, c AS (SELECT o, CASE f WHEN 'R' THEN 'stated' WHEN 'A' THEN 'carried' ELSE 'background' END AS t, count(*) AS n FROM i GROUP BY ALL) SELECT o AS section, string_agg(t || ':' || n, ' ' ORDER BY t) AS histogram FROM c GROUP BY o""")
def premise_histograms(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("f") == "R", "stated").when(F.col("f") == "A", "carried").otherwise("background")
    return review.premise_histogram(_items(spark, folder).select(F.col("o").alias("section"), kind.alias("type")), ["section"])


@query("""SELECT o_custkey AS k, string_agg('## ' || o_orderpriority || chr(10) || o_orderstatus || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) AS block FROM orders GROUP BY o_custkey""")
def memo_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Memos of a unit one under another, each under its title."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority", _text(F.col("o_orderstatus"), F.col("o_orderkey")).alias("body"))
    return review.format_blocks(o, "k", "o_orderpriority", "body", "o_orderkey")


@query("""SELECT event_id AS model_key, event_type AS module, CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE 'p' || user_id % 3 END AS provider, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS retries, value >= 10 AS success,
  '{"input":' || user_id || ',"output":' || event_id || ',"cacheRead":0}' AS tokens, CASE WHEN value < 10 THEN least(2000, 100 * user_id) END::INTEGER AS message_length FROM events WHERE event_type <> 'signup'""")
def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """Calls as rows of a log: defaults, tokens as JSON, messages cut to 2,000
    characters; calls without a module are left out.  The messages, made here, are
    up to twice as long, so that the cut is met but they don't grow with the ids."""
    user = F.col("user_id")
    calls = table(spark, folder, "events").select(
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("module"), F.col("event_id").alias("model_key"), F.when(user % 3 != 0, _text("p", user % 3)).alias("provider"), F.when(user % 2 == 0, 1).alias("retries"),
        F.when(F.col("value") >= 10, True).alias("success"), user.alias("input"), F.col("event_id").alias("output"), F.lit(0).alias("cache_read"), F.when(F.col("value") < 10, F.repeat(F.lit("x"), F.least(user * 100, F.lit(4000)).cast("int"))).alias("error_message"),
    )
    return review.call_log(calls).withColumn("message_length", F.length("error_message")).drop("error_message")


@query("""WITH s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_type AS kind, CASE WHEN value >= 50 THEN true WHEN value < 10 THEN false END AS ok FROM events)
SELECT run, step::INTEGER AS step, message FROM (SELECT run, step, ok, CASE WHEN ok THEN 'done ' ELSE 'failed ' END || kind || ' (' || count(ok) OVER (PARTITION BY run ORDER BY step) || '/' || count(*) OVER (PARTITION BY run) || ')' AS message FROM s) WHERE ok IS NOT NULL""")
def run_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Progress of runs as messages."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("step"), F.col("event_type").alias("kind"), "value")
    done = e.where("value >= 50 or value < 10").select("run", "step", (F.col("value") >= 50).alias("ok"))
    return review.progress(e.select("run", "step", "kind"), done)


_LINKS = f"g AS (SELECT a.id AS f, b.id AS t FROM x {_TARGET} WHERE b.id IS NOT NULL), deg AS (SELECT id, count(*) AS n FROM (SELECT f AS id FROM g UNION ALL SELECT t FROM g) GROUP BY id)"


@query(f"""WITH {_EDGES}, {_PLACES}, {_REFS}, {_LINKS}, c AS (SELECT k.unit, k.id AS node_id, (CASE i.f WHEN 'R' THEN 2 ELSE 0 END + (k.id IN (SELECT id FROM t WHERE id IS NOT NULL))::INT + least(coalesce(deg.n, 0), 4))::INTEGER AS score, k.pos, i.n
  FROM k JOIN w ON w.unit = k.unit AND w.pos = k.pos JOIN i ON i.o = w.o AND 'A' || i.n = k.local LEFT JOIN deg ON deg.id = k.id)
SELECT unit, node_id, score, row_number() OVER (PARTITION BY unit ORDER BY score DESC, pos, n)::INTEGER AS rank FROM c QUALIFY rank <= 12""")
def argument_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve arguments of each unit that a review looks at first: by their
    grounding, whether scaffolding stands on them, and their links."""
    c = graph.linked_nodes(*_graphs(spark, folder))
    grounded = F.when(F.col("grounding") == "concrete", 2).when(F.col("grounding") == "namedropping", 1).otherwise(0)
    c = c.withColumn("score", graph.candidate_score(grounded, F.col("held"), F.col("degree")))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("score"), "position", F.substring("local_id", 2, 9).cast("int")))
    return c.withColumn("rank", rank).where("rank <= 12").select("unit", "node_id", "score", "rank")
