"""Work that must not grow faster than the input."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import citations
from quillspark.operators import dictionary, worklist
from quillspark.operators.collapse import collapse
from quillspark.plans import writings
from quillspark.sources import docx, export, formats


def test_patterns_that_begin_alike_cost_no_more(spark):
    names = spark.range(30_000).selectExpr("concat('s', id) seed_id", "0 place", "concat('Customer#', lpad(id, 9, '0')) pattern")
    texts = spark.range(40).selectExpr("id document_id", "concat(repeat('customer#no ', 500), 'CUSTOMER#', lpad(id, 9, '0')) text")
    began = time.perf_counter()
    got = sorted((r["document_id"], r["seed_id"], r["candidate"], r["start"], r["context"]) for r in dictionary.scan(texts, names, context=3).collect())
    assert got == sorted((k, f"s{k}", f"Customer#{k:09}", 6000, f"no CUSTOMER#{k:09}") for k in range(40))
    assert time.perf_counter() - began < 60  # 600 million pairs by the first four characters


def test_annotations_are_read_without_a_shuffle(spark):
    t = "Zusammenfassung der Anmerkungen in x.pdf\r\nFront\n2.1.3 Teil  \r\nNotiz [Seite 7]: \n 12 \n\n12\nHervorheben [Seite 1]:  a\r\n b\nText [Seite 2]: n\nText [Seite 3]:"
    a = formats.annotations(spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "12")], "doc_id int, text string"))
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in a.collect()] == [
        (1, "heading", "Front", None, None, 0, 1, None, None, None, 0, 5), (1, "heading", "2.1.3 Teil", None, None, 1, 3, None, None, None, 6, 16),
        (1, "annotation", "12", "Notiz", 7, 2, None, "2.1.3 Teil", "commenting", None, 17, 19), (1, "annotation", "a\n b", "Hervorheben", 1, 3, None, "2.1.3 Teil", "citing", None, 20, 24),
        (1, "annotation", "n", "Text", 2, 4, None, "2.1.3 Teil", "commenting", 3, 25, 26), (1, "annotation", "", "Text", 3, 5, None, "2.1.3 Teil", "commenting", 3, 27, 27),
    ]


def test_entries_are_gathered_once_for_all_citations(spark):
    e = spark.range(400).selectExpr("cast(id as string) entry_id", "'d' document_id", "'A' last_name", "'1999' year", "case when id % 100 = 0 then 'a' end suffix")
    c = spark.range(4000).selectExpr("id citation_id", "'d' document_id", "'A' author", "'1999' year", "case id % 3 when 0 then 'a' when 1 then 'b' end suffix")
    c = c.unionByName(c.where("citation_id = 0").selectExpr("citation_id", "document_id", "author", "'2001' year", "suffix")).unionByName(c.where("citation_id = 1").selectExpr("-1L citation_id", "document_id", "'B' author", "year", "suffix"))
    out = citations.resolve(c, e)
    got = {r["citation_id"]: r["entry_ids"] for r in out.collect()}
    a, every = ["0", "100", "200", "300"], sorted(map(str, range(400)))
    assert got == {-1: [], **{k: a if k % 3 == 0 else every for k in range(4000)}}
    plan, rows = out._jdf.queryExecution().executedPlan(), []
    walk = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while walk:
        node = walk.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        below = [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        walk += below
    assert rows and max(rows) <= 5000  # 1.6 million pairs of a citation and an entry


def test_files_leave_python_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(docx, "SENT", 2000)
    e = spark.range(300).selectExpr("id document_id", "0L char_start", "'paragraph' element_type", "cast(null as int) level", "repeat('x ', 200) content")
    files = [(str(r[0]), bytes(r[1])) for r in export.docx(e).collect()] + [("bad", b"no")]
    batch = pa.record_batch([pa.array([f[k] for f in files]) for k in (0, 1)], names=["document_id", "content"])
    out = list(docx._read(iter([batch, batch])))
    assert sum(b.num_rows for b in out) == 602 and max(b.num_rows for b in out) <= 10
    assert sorted(r["document_id"] for b in out for r in b.to_pylist()) == sorted(2 * [f[0] for f in files])


def test_counted_facts_are_the_same_work(spark):
    names, phases = ("a", "b"), (worklist.Phase("one", "p", "n_a >= 2"), worklist.Phase("two", "p", "has_b", needs=("one",)))
    atoms = spark.createDataFrame([(u, "p", f"p{u}{k}", k) for u in range(3) for k in range(2)], "unit int, kind string, atom string, at long")
    rows = [("p", "p00", "a"), ("p", "p00", "a"), ("p", "p01", "a"), ("p", "p10", "a"), ("p", "p10", "a"), ("p", "p11", "a"), ("p", "p11", "a"), ("p", "p11", "b")]
    facts = spark.createDataFrame(rows, "kind string, atom string, fact string")
    counted = spark.createDataFrame([("p", "p00", 1), ("p", "p00", 1), ("p", "p01", 1), ("p", "p10", 2), ("p", "p11", 2)], "kind string, atom string, n_a int").unionByName(spark.createDataFrame([("p", "p11", 1)], "kind string, atom string, n_b int"), allowMissingColumns=True)
    both = [(sorted(map(tuple, worklist.work_lists(atoms, f, names, phases).collect())), sorted(map(tuple, worklist.pending(atoms, f, names, phases).collect()))) for f in (facts, counted)]
    assert both[0] == both[1] and both[0][1] == [(0, "one", "p01", 1), (1, "two", "p10", 0), (2, "one", "p20", 0), (2, "one", "p21", 1)]


def test_the_latest_value_may_be_another(spark):
    nodes = spark.createDataFrame([("d", 0, None, 0, 0, 1, "r"), ("d", 1, 0, 1, 1, 4, "x"), ("d", 2, 0, 1, 2, 3, "y")], "d string, node int, parent int, depth int, at int, value long, label string")
    even = F.when(F.col("value") % 2 == 0, F.col("value"))
    out = {r["node"]: (r["total"], r["latest"], r["joined"]) for r in collapse(nodes, "d", "|", latest=even).collect()}
    assert out == {0: (8, 4, "x|y"), 1: (4, 4, "x"), 2: (3, None, "y")}


def test_texts_made_from_a_small_table_are_dealt_out(spark, sf):
    for q in (writings.inline_citations(spark, sf), writings.cited_authors(spark, sf)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") == plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # one task read all of them
        assert q.rdd.getNumPartitions() > 1


def test_a_form_is_read_once_for_all_texts(spark):
    t = "\x01Ä\x02 $1 (vgl. Bohnsack, 2010;\x01 Cramer und Groß 2019b: 4–5) \U0001f600 Klafki u. a.\n(1999)\x02"
    df = spark.createDataFrame([(t,), ("\x01\x02",), ("2010",), (None,)], "t string").select(citations.citations_of("t").alias("c"))
    assert [[tuple(c) for c in r["c"]] for r in df.collect()] == [
        [(t.index("Bohnsack"), "Bohnsack, 2010", ["Bohnsack"], "2010", None, None), (t.index("Cramer"), "Cramer und Groß 2019b: 4–5", ["Cramer", "Groß"], "2019", "b", "4–5"), (t.index("Klafki"), "Klafki u. a.\n(1999)", ["Klafki"], "1999", None, None)], [], [], [],
    ]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in (citations._NARRATIVE, citations._INSIDE) if f", {x}, -1)" in plan]  # a split reads its form anew for each text
