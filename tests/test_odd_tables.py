"""Queries against their SQL over small tables of odd rows."""

import duckdb

from quillspark import catalogue
from quillspark.functions import prose
from quillspark.operators import graph
from tests.test_catalogue import plain


def same(spark, folder, name, **tables):
    """The rows of a query over ``tables`` (SQL of each), after comparing them with its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*sorted(df.columns)).collect())
    said = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in said.description]
    order = [names.index(c) for c in sorted(df.columns)]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in said.fetchall())
    return df


def test_halves_of_stacks_go_to_the_even_number(spark, tmp_path):
    rows = "SELECT * FROM (VALUES (1, 1, 'error', 2.5::DOUBLE), (2, 2, 'error', 3.5), (3, 3, 'view', 4.5), (4, 4, 'error', 3.4), (5, 5, 'view', NULL), (6, 6, NULL, 4)) t(event_id, user_id, event_type, value)"
    got = {r["user_id"]: (r["has_error_3"], r["has_4"]) for r in same(spark, tmp_path, "stack_predicates", events=rows).where("user_id < 5").collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (False, True), 4: (True, False)}


def test_a_cited_name_is_a_citation_wherever_it_stands(spark, tmp_path):
    long = "und so weiter in einem langen Absatz ohne Ende"
    rows = f"SELECT * FROM (VALUES (1, '{long} bis Haus'), (2, '{long} bis Der'), (3, 'x' || chr(10) || '{long} mit Quell im Text'), (4, 'xy' || chr(10) || '{long} mit Quellen')) t(doc_id, text)"
    got = {(r["document_id"], r["token"]): r["kind"] for r in same(spark, tmp_path, "grounded_tokens", documents=rows).collect()}
    assert got[1, "Quell"] == got[2, "Quell"] == got[3, "Quell"] == "citation" and got[4, "Quellen"] == "proper_noun"


def test_a_distinctive_word_ends_where_its_letters_end(spark, tmp_path):
    long = "und so weiter in einem langen Absatz ohne Ende"
    rows = f"SELECT * FROM (VALUES (1, '{long} AKIAF7QX Haus_ Grünä9 Abc-'' Mühl-Baum8 Land- Land'' 9Berg _Berg xÄBerg'), (2, '{long} Haus und'), (3, '{long} Meier &'), (4, '{long} Weg-'), (5, '{long} Der, Tal/')) t(doc_id, text)"
    got = {(r["document_id"], r["token"]): r["kind"] for r in same(spark, tmp_path, "grounded_tokens", documents=rows).collect()}
    assert {t for d, t in got if d == 1} == {"Absatz", "AKIAF", "Haus", "Grünä", "Mühl-Baum", "Land", "Berg", "Quell"}
    assert {t for (_, t), kind in got.items() if kind == "citation"} == {"Quell"}


def test_answers_are_read_within_their_rows(spark):
    raw = spark.createDataFrame([("r", "ARGUMENT A1\r\nclaim : one\r\n goes on \r\nARGUMENT A1\nclaim: later\nARGUMENT A2\nclaim: x\nclaim: y\nEDGES\nA2 -supports-> A1"), (None, "ARGUMENT A1\nclaim: z")], "atom_id string, raw_text string")
    t = prose.argument_graph(raw)
    assert all("Exchange" not in t[k]._jdf.queryExecution().executedPlan().toString() for k in ("arguments", "premises", "edges", "scaffolding", "warnings"))
    assert {(r["atom_id"], r["local_id"], r["claim"]) for r in t["arguments"].collect()} == {("r", "A1", "one\n goes on"), ("r", "A2", "y"), (None, "A1", "z")}


def test_messages_of_large_users(spark, tmp_path):
    rows = "SELECT * FROM (VALUES (1, 30000000::BIGINT, 'error', 5::DOUBLE), (2, 21, 'error', 5), (3, 20, 'view', 5), (4, 3, 'view', 50), (5, 7, 'signup', 5)) t(event_id, user_id, event_type, value)"
    got = {r["model_key"]: r["message_length"] for r in same(spark, tmp_path, "call_log", events=rows).collect()}
    assert got == {1: 2000, 2: 2000, 3: 2000, 4: None}


def test_stored_edges_shuffle_little(spark):
    raw = spark.createDataFrame([("p", "ARGUMENT A1\nclaim: one"), ("q", "ARGUMENT A1\nclaim: x\nEDGES\nA1 -contradicts-> §1:A1\nA1 -supports-> A9\nA7 -supports-> A1")], "atom_id string, raw_text string")
    paragraphs = spark.createDataFrame([("p", "u", 1, "a", 0), ("q", "u", 2, "b", 9), ("z", "u", 3, "c", 20)], "atom_id string, unit string, position int, text string, char_start long")
    s = graph.stored_graph(prose.argument_graph(raw), paragraphs)
    assert s["edges"]._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert [tuple(r) for r in s["edges"].select("from_node", "to_node").collect()] == [("u/2/A1", "u/1/A1")]
    assert {tuple(r) for r in s["errors"].collect()} == {("q", "A9", "no such argument"), ("z", None, "nothing found")}


def test_candidates_read_answers_once(spark, tmp_path):
    orders = "SELECT * FROM (VALUES (1, 7), (2, 7), (3, 7), (4, 8), (5, NULL), (6, 9), (6, 9), (9, 8)) t(o_orderkey, o_custkey)"
    items = "SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS l_partkey, 3 AS l_suppkey, 4.0 + (l_orderkey + l_linenumber) % 4 AS l_quantity, ((l_orderkey * 3 + l_linenumber) % 10) / 100.0 AS l_discount, ['R', 'A', 'N'][(l_orderkey + l_linenumber * 2) % 3 + 1] AS l_returnflag"
    rows = f"{items} FROM range(1, 8) a(l_orderkey), range(1, 6) b(l_linenumber) UNION ALL {items} FROM (VALUES (1, 1), (2, 12), (8, 1)) t(l_orderkey, l_linenumber)"
    c = same(spark, tmp_path, "argument_candidates", orders=orders, lineitem=rows)
    assert {r["unit"] for r in c.collect()} == {"c7", "c8", "c9"}
    assert not [f for f in c.inputFiles() if "/nodes-" not in f]  # lineitem was read and parsed anew for the nodes


def test_long_answers_are_read_in_passes_over_the_whole(spark):
    raw = "In front.\r\n" + "".join(f"ARGUMENT A{k}\r\nclaim: c{k}\r\n goes on\r\n\r\nanchor : p\rq\r\nGrounding: Concrete\r\n" for k in range(400)) + "ARGUMENT A7\nclaim: later\nEDGES\nA1 -supports--> A2, §2:A3 (x)\nARGUMENT B1\nargument a400\nARGUMENT A401"
    t = prose.argument_graph(spark.createDataFrame([("r", raw)], "atom_id string, raw_text string"))
    got = {r["local_id"]: (r["claim"], r["anchor_phrase"], r["grounding"]) for r in t["arguments"].collect()}
    assert got == {f"A{k}": (f"c{k}\n goes on\n\nanchor : p\rq", "", "concrete") for k in range(400)}
    assert [tuple(r)[1:4] for r in t["edges"].collect()] == [("A1", "A2", "supports"), ("A1", "§2:A3", "supports")]
    lines = "split(raw_text"  # each line was an element that a pattern was tried on
    assert lines not in t["rows"]._jdf.queryExecution().optimizedPlan().toString()
