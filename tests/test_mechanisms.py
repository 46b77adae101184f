"""JSON rewrites, intervals, trees, collapse, dictionaries, work lists and streams
against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import json_values as js
from quillspark.operators import dictionary, intervals, state, worklist
from quillspark.operators.collapse import collapse
from quillspark.operators.worklist import Phase
from quillspark.sources import trees
from quillspark.streaming import poison, runs
from quillspark.streaming.arrivals import Arrivals

# -- JSON


def text(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 5:
        return [None, True, rng.randrange(-50, 50), rng.choice(["", "a b", 'q"\\', "é\n"]), False][kind]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: value(rng, depth + 1) for k in rng.sample(["a", "b", "k", "x y", "0"], rng.randrange(5))}


RNG = random.Random(5)
VALUES = [value(RNG) for _ in range(300)]
PATHS = [["a"], ["a", "b"], ["b", "0"], ["b", "-1"], ["0", "1", "k"], ["k", "9"], ["k", "-9"], ["x y"], ["a", "k", "-2", "0"]]


def plain_merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | b
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def place(step, n):
    return None if not re.fullmatch(r"-?\d+", step) else int(step) if int(step) >= 0 else n + int(step)


def plain_change(v, path, leaf):
    step, rest = path[0], path[1:]
    if not rest:
        return leaf(v, step) if isinstance(v, (dict, list)) else v
    if isinstance(v, dict):
        return v | {step: plain_change(v[step], rest, leaf)} if step in v else v
    if isinstance(v, list):
        k = place(step, len(v))
        return [plain_change(x, rest, leaf) if i == k else x for i, x in enumerate(v)]
    return v


def plain_set(new, create=True):
    def leaf(v, step):
        if isinstance(v, dict):
            return v | {step: new} if create or step in v else v
        k = place(step, len(v))
        if k is None:
            return v
        if 0 <= k < len(v):
            return v[:k] + [new] + v[k + 1 :]
        return v if not create else [new] + v if k < 0 else v + [new]

    return leaf


def plain_insert(new, after=False):
    def leaf(v, step):
        if isinstance(v, dict):
            return v if step in v else v | {step: new}
        k = place(step, len(v))
        return v if k is None else v[: (k := min(max(k + after, 0), len(v)))] + [new] + v[k:]

    return leaf


def plain_delete(v, step):
    if isinstance(v, dict):
        return {k: x for k, x in v.items() if k != step}
    k = place(step, len(v))
    return [x for i, x in enumerate(v) if i != k]


def test_json_values_are_plain_json(spark):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(zip(VALUES, VALUES[1:] + VALUES[:1], strict=True))]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = {r["i"]: r["m"] for r in df.select("i", js.merge(a, b).alias("m")).collect()}
    assert got == {i: text(plain_merge(VALUES[i], VALUES[(i + 1) % len(VALUES)])) for i in range(len(VALUES))}
    new = F.lit('{"n":[1]}')
    for path in PATHS:
        out = df.select(
            "i", js.set_path(a, path, new).alias("s"), js.set_path(a, path, new, create=False).alias("u"), js.insert_path(a, path, new).alias("n"), js.insert_path(a, path, new, after=True).alias("t"), js.delete_path(a, path).alias("d")
        )
        n = {"n": [1]}
        leaves = {"s": plain_set(n), "u": plain_set(n, False), "n": plain_insert(n), "t": plain_insert(n, True), "d": plain_delete}
        for r in out.collect():
            for name, leaf in leaves.items():
                assert r[name] == text(plain_change(VALUES[r["i"]], path, leaf)), (VALUES[r["i"]], path, name)


def test_json_of_nulls_and_broken_texts(spark):
    rows = [(1, None, "{}"), (2, "{", "{}"), (3, "", "1"), (4, '{"a":1,"a":2}', '{"b":null}'), (5, " [ 1 ] ", "[]"), (6, "{}", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r["i"]: (r["m"], r["d"]) for r in df.select("i", js.merge(F.col("a"), F.col("b")).alias("m"), js.delete_path(F.col("a"), ["a"]).alias("d")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: ('{"a":2,"b":null}', "{}"), 5: ("[1]", "[1]"), 6: (None, "{}")}
    assert df.select(js.set_path(F.col("b"), ["x"], F.lit(None).cast("string")).alias("s")).where("s is not null").count() == 0


def test_merged_is_a_fold(spark):
    rows = [(i % 7, i, json.dumps(v) if isinstance(v, dict) else None if i % 3 else json.dumps(v)) for i, v in enumerate(VALUES)]
    got = {r["k"]: r["p"] for r in js.merged(spark.createDataFrame(rows, "k int, i int, p string"), ["k"], ["i"], "p").collect()}
    want = {k: {} for k in range(7)}
    for k, _, p in rows:
        if p and isinstance(json.loads(p), dict):
            want[k] |= json.loads(p)
    assert got == {k: text(v) for k, v in want.items()}


def test_upsert_merges_and_coalesces(spark):
    old = spark.createDataFrame([(1, "a", '{"x":1,"y":2}'), (2, "b", None), (3, "c", '{"x":1}')], "id int, mode string, props string")
    new = spark.createDataFrame([(1, None, '{"y":null,"z":3}'), (2, "d", "{}"), (4, "e", '{"q":1}')], "id int, mode string, props string")
    got = sorted(map(tuple, state.upsert(old, new, ["id"], merged=("props",)).collect()))
    assert got == [(1, "a", '{"x":1,"y":null,"z":3}', "updated"), (2, "d", "{}", "updated"), (3, "c", '{"x":1}', "unchanged"), (4, "e", '{"q":1}', "created")]


# -- intervals


def test_intervals_are_brute_force(spark):
    rng = random.Random(2)
    points = [(rng.choice("abc"), rng.randrange(-100, 300_000)) for _ in range(400)] + [(None, 5), ("a", None), ("a", 0), ("a", 0)]
    ranges = [(rng.choice("abd"), s := rng.randrange(-200, 300_000), s + rng.choice([0, 1, 2, 3, 64, 65, 1000, 70_000, 300_000])) for _ in range(120)] + [(None, 0, 10), ("a", 9, 3), ("a", None, 3), ("a", 3, None), ("a", 0, 1)]
    p = spark.createDataFrame(points, "k string, at long").withColumn("note", F.lit("p"))
    r = spark.createDataFrame(ranges, "k string, s long, e long")
    ok = lambda k, a, rk, s, e: None not in (k, a, s, e) and k == rk and s <= a < e
    got = sorted((x["k"], x["at"], x["s"], x["e"]) for x in intervals.matches(p, r, "k", "at", "s", "e").collect())
    assert got and got == sorted((k, a, s, e) for k, a in points for rk, s, e in ranges if ok(k, a, rk, s, e))
    want = sorted(((k, a, "p", any(ok(k, a, *x) for x in ranges)) for k, a in points), key=str)
    for width in (1 << 16, 50):
        assert sorted(map(tuple, intervals.covered(p, r, "k", "at", "s", "e", width).collect()), key=str) == want
    left = [(k, s, s + n) for k, s, n in [("a", 5, 0), ("a", 5, 10), ("b", 1000, 90_000), ("d", 7, 1), ("a", -50, 400_000)]]
    both = intervals.overlapping(spark.createDataFrame(left, "k string, a long, b long"), r, "k", ("a", "b"), ("s", "e"))
    got = sorted((x["k"], x["a"], x["b"], x["s"], x["e"]) for x in both.collect())
    assert got == sorted((k, a, b, s, e) for k, a, b in left for rk, s, e in ranges if rk == k and None not in (s, e) and a < b and s < e and a < e and s < b)
    assert intervals.matches(p.limit(0), r, "k", "at", "s", "e").count() == 0 and intervals.covered(p, r.limit(0), "k", "at", "s", "e").where("covered").count() == 0


def test_wide_ranges_are_few_rows(spark):
    """A range of a billion positions is two rows at most, a point one for each class."""
    r = spark.createDataFrame([("a", 3, 1_000_000_003)] * 50, "k string, s long, e long")
    p = spark.range(200).select(F.lit("a").alias("k"), (F.col("id") * 5_000_000).alias("at"))
    out = intervals.matches(p, r, "k", "at", "s", "e")
    assert out.count() == 50 * 199


# -- trees

PAGE = '<html><body><h1 id="top">T</h1><p>a <a href="#end">to</a><br>b</p><ul><li>x<li>y</ul><h2>S</h2><p>c</b> <a href="#top">up</a> <a href="#no">no</a></p><h3 id="end">E</h3><label for="top">l</label></body>'


def test_page_nodes_by_hand():
    rows = list(trees.page_nodes(PAGE))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [
        (0, None, 0, 0, "html"), (1, 0, 0, 1, "body"), (2, 1, 0, 2, "h1"), (3, 1, 1, 2, "p"), (4, 3, 0, 3, "a"), (5, 3, 1, 3, "br"), (6, 1, 2, 2, "ul"), (7, 6, 0, 3, "li"), (8, 7, 0, 4, "li"),
        (9, 1, 3, 2, "h2"), (10, 1, 4, 2, "p"), (11, 10, 0, 3, "a"), (12, 10, 1, 3, "a"), (13, 1, 5, 2, "h3"), (14, 1, 6, 2, "label"),
    ]
    assert {r[0]: r[6] for r in rows if r[6]} == {3: [(2, "section")], 4: [(2, "section"), (13, "link")], 9: [(2, "section")], 10: [(9, "section")], 11: [(2, "link"), (9, "section")], 12: [(9, "section")], 13: [(9, "section")], 14: [(2, "link")]}
    assert rows[3][5] == "a b" and list(trees.page_nodes(None)) == list(trees.page_nodes("")) == list(trees.page_nodes("no tag")) == []


def brute_tree(html):
    """Parents by looking back through the tags, for pages without stray ends."""
    tags = re.findall(r"<(/?)([a-z][a-z0-9]*)[^>]*?>", re.sub(r"(?s)<!--.*?-->|<!doctype[^>]*>|(<(script|style)[^>]*>).*?(</\2>)", r"\1\3", html, flags=re.I), flags=re.I)
    starts, out = [], []
    for k, (end, tag) in enumerate(tags):
        if end:
            continue
        open_, skip = None, []
        for e, t in reversed(tags[:k]):
            t = t.lower()
            if e:
                skip.append(t)
            elif t in skip:
                del skip[: skip.index(t) + 1]
            elif t not in trees.VOID:
                open_ = True
                break
        depth = 0
        stack = []
        for e, t in tags[:k]:
            t = t.lower()
            if not e and t not in trees.VOID:
                stack.append((t, sum(1 for x, _ in tags[: len(starts)] if not x)))
            elif e and any(x[0] == t for x in stack):
                while stack.pop()[0] != t:
                    pass
        depth = len(stack)
        starts.append(k)
        out.append((depth, tag.lower(), open_ is not None))
    return out


def test_page_trees_are_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(15)
    rows = trees.page_elements(pages).orderBy("page_id", "idx").collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r["page_id"], []).append(r)
    assert len({r["id"] for r in rows}) == len(rows)
    for p in pages.collect():
        mine = by_page[p["page_id"]]
        want = brute_tree(p["html"])
        assert [(r["depth"], r["tag"]) for r in mine] == [w[:2] for w in want]
        ids = {r["idx"]: r["id"] for r in mine}
        for r in mine:
            # the parent is the last row before it that is one less deep
            up = max((q["idx"] for q in mine if q["idx"] < r["idx"] and q["depth"] == r["depth"] - 1), default=None)
            assert r["parent"] == up and r["parent_id"] == ids.get(up)
            assert r["sibling"] == sum(1 for q in mine if q["idx"] < r["idx"] and q["parent"] == r["parent"])


def test_references_become_ids(spark):
    e = trees.page_elements(spark.createDataFrame([(1, PAGE), (2, PAGE), (3, None)], "page_id int, html string"))
    ids = {(r["page_id"], r["idx"]): r["id"] for r in e.collect()}
    got = {(r["page_id"], r["from_id"], r["to_id"], r["type"]) for r in trees.references(e).collect()}
    assert {(1, ids[1, 4], ids[1, 13], "link"), (2, ids[2, 11], ids[2, 2], "link"), (1, ids[1, 10], ids[1, 9], "section")} <= got and len(got) == 20


def test_level_tree_and_collapse_are_recursion(spark):
    rng = random.Random(8)
    docs = [(d, [rng.choice([1, 2, 3, 4, None, None]) for _ in range(rng.randrange(40))]) for d in range(12)] + [(50, None), (51, [])]
    flat = trees.level_tree(spark.createDataFrame(docs, "d int, levels array<int>"), F.col("levels"), "d")
    got = {}
    for r in flat.collect():
        got.setdefault(r["d"], {})[r["idx"]] = r
    assert set(got) == {d for d, v in docs if v}
    for d, levels in docs:
        for i, level in enumerate(levels or []):
            up = None
            for k in range(i - 1, -1, -1):
                own = 99 if level is None else level
                if levels[k] is not None and levels[k] < own and all(levels[m] is None or levels[m] > levels[k] for m in range(k + 1, i)):
                    up = k
                    break
            assert got[d][i]["parent"] == up
    nodes = flat.select("d", F.col("idx").alias("node"), "parent", "depth", F.col("idx").cast("long").alias("at"), F.when(F.col("idx") % 3 != 0, F.col("idx").cast("long")).alias("value"), F.col("idx").cast("string").alias("label"))
    out = {(r["d"], r["node"]): r for r in collapse(nodes, "d").collect()}

    def below(d, i):
        found = [k for k, r in sorted(got[d].items()) if r["parent"] == i]
        return [x for k in found for x in [k, *below(d, k)]]

    for (d, i), r in out.items():
        under = below(d, i)
        mine = [x for x in [i, *under] if x % 3]
        leaves = [x for x in [i, *under] if not any(q["parent"] == x for q in got[d].values())]
        assert (r["n_below"], r["total"], r["latest"], r["joined"]) == (len(under), sum(mine), max(mine, default=None), " ".join(map(str, leaves)))
    assert len(out) == sum(len(v) for v in got.values()) and collapse(nodes.limit(0), "d").count() == 0


# -- dictionary


def test_dictionary_scan_is_a_plain_search(spark):
    rng = random.Random(4)
    words = ["anna", "Muster", "İda", "ab", "abc", "x", "Größe", "a.b", "mail@x.org", "straße"]
    texts = [(i, " ".join(rng.choice([*words, "fill", "muster-", "xAnna", "AB,", "ABC"]) for _ in range(rng.randrange(12)))) for i in range(120)] + [(200, None), (201, ""), (202, "ab")]
    patterns = [(f"s{k}", j, x) for k in range(25) for j, x in enumerate(rng.sample([*words, "anna muster", "muster muster", "zz", ".", "nothing here", "abcd"], 3))] + [("none", 0, None), ("none", 1, ""), ("dot", 0, ".")]
    got = sorted(map(tuple, dictionary.scan(spark.createDataFrame(texts, "document_id int, text string"), spark.createDataFrame(patterns, "seed_id string, place int, pattern string"), context=5).collect()))
    want = []
    for d, t in texts:
        for seed in {p[0] for p in patterns}:
            for _, _, p in sorted(x for x in patterns if x[0] == seed and x[2]):
                low, low_p = dictionary.lowered(t or ""), dictionary.lowered(p)
                if len(p) > 3:
                    at = low.find(low_p)
                else:
                    m = re.search(rf"(?a)\b{re.escape(low_p)}\b", low)
                    at = m.start() if m else -1
                if at >= 0:
                    want.append((d, seed, p, at, t[max(0, at - 5) : at + len(p) + 5]))
                    break
    assert want and got == sorted(want)


# -- work lists


def test_work_lists_are_plain_counts(spark):
    rng = random.Random(6)
    atoms = [(f"u{i % 5}", rng.choice(["p", "s"]), f"a{i}", rng.randrange(20)) for i in range(80)] + [("lone", "s", "z", 1)]
    facts = [(k, a, rng.choice(["done", "half", "failed", "odd"])) for _, k, a, _ in atoms for _ in range(rng.randrange(4))]
    phases = [Phase("one", "p", "has_done", failed="has_failed"), Phase("two", "s", "n_half >= 2", only="has_half or has_done", needs=("one",)), Phase("three", "s", "has_done and not has_failed", needs=("one", "two"))]
    a, f = spark.createDataFrame(atoms, "unit string, kind string, atom string, at int"), spark.createDataFrame(facts, "kind string, atom string, fact string")
    names = ("done", "half", "failed")
    got = {(r["unit"], r["phase"]): r.asDict() for r in worklist.work_lists(a, f, names, phases).collect()}
    n = lambda atom, fact: sum(1 for x in facts if x[1] == atom and x[2] == fact)
    test = {
        "one": ("p", lambda x: True, lambda x: n(x, "done") > 0, lambda x: n(x, "failed") > 0), "two": ("s", lambda x: n(x, "half") + n(x, "done") > 0, lambda x: n(x, "half") >= 2, lambda x: False),
        "three": ("s", lambda x: True, lambda x: n(x, "done") > 0 and not n(x, "failed"), lambda x: False),
    }
    waits = {}
    for u in {x[0] for x in atoms}:
        for name, (kind, only, done, failed) in test.items():
            mine = [x for x in atoms if x[0] == u and x[1] == kind and only(x[2])]
            waits[u, name] = sorted((x[3], x[2]) for x in mine if not done(x[2]) and not failed(x[2]))
            r = got[u, name]
            assert (r["total"], r["done"], r["pending"]) == (len(mine), sum(done(x[2]) for x in mine), len(waits[u, name]))
            assert r["next_atom"] == (waits[u, name][0][1] if waits[u, name] else None)
    for u in {x[0] for x in atoms}:
        assert got[u, "one"]["open"] and got[u, "two"]["open"] == (not waits[u, "one"]) and got[u, "three"]["open"] == (not waits[u, "one"] and not waits[u, "two"])
    open_ = sorted((r["unit"], r["phase"], r["at"], r["atom"]) for r in worklist.pending(a, f, names, phases).collect())
    assert open_ == sorted((u, p, *x) for (u, p), some in waits.items() for x in some if got[u, p]["open"])


# -- streams


def test_stacks_go_on_from_the_stored_state(spark, sf):
    """Every part is a new stream on the old state; what arrives late changes nothing newer."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id <= 6")
    late = e.withColumn("event_id", F.pmod(F.col("event_id") * 7, F.lit(1009)))  # parts hold events in another order
    rows = runs.stacked(spark, late, 4)
    last = {r["key"]: (r["depth"], r["current"]) for r in rows.groupBy("key").agg(F.max(F.struct("batch", "depth", "current")).alias("l")).select("key", "l.*").collect()}
    kinds = late.withColumn("kind", F.when(F.col("event_type") == "signup", "origin").otherwise("re_spec")).withColumn("anchors", F.array("event_type"))
    want = {r["user_id"]: (r["depth"], r["current"]) for r in state.version_stack(kinds, "user_id", ["event_id"], "anchors", "value").collect()}
    assert last == want and rows.select("batch").distinct().count() >= 4


def test_idle_stacks_are_closed(spark):
    ts = lambda day: f"2024-01-{day:02d} 00:00:00"
    data = [(1, 1, "signup", 1.0, ts(1)), (2, 1, "view", 2.0, ts(2)), (3, 2, "view", 3.0, ts(2)), (11, 2, "click", 4.0, ts(9)), (21, 1, "view", 5.0, ts(20)), (31, 3, "view", 6.0, ts(28))]
    e = spark.createDataFrame(data, "event_id long, user_id long, event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = [(r["key"], r["depth"], r["current"], r["closed"]) for r in runs.stacked(spark, e, 4, idle="3 days").orderBy("batch", "closed").collect()]
    assert (1, 2, 2.0, True) in rows  # closed after the second of January
    assert (1, 1, 5.0, False) in rows  # and begun anew, without what it had
    assert (2, 2, 4.0, False) not in rows or (2, 1, 3.0, True) not in rows


def test_poison_rows_are_kept_aside_and_tried_again(spark):
    source = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "7"), (5, "y")], "id long, v string")
    intake = poison.Intake(source, "id", "v", "bigint", most=2)
    seen = []

    def strict(v):
        return int(v)

    assert intake.run(strict) == 0
    assert sorted(map(tuple, intake.good().collect())) == [(1, 5, 1, 0), (4, 7, 1, 0)]
    bad = {r["id"]: (r["reason"].split(":")[0], r["attempt"]) for r in intake.open().collect()}
    assert bad == {2: ("ValueError", 1), 3: ("TypeError", 1), 5: ("ValueError", 1)}
    spark.range(1).write.parquet(f"{intake.folder}/run=1/good")  # a run that died before it ended
    assert intake.run(lambda v: 99 if v == "x" else int(v)) == 1
    assert sorted(map(tuple, intake.good().collect())) == [(1, 5, 1, 0), (2, 99, 2, 1), (4, 7, 1, 0)]
    assert intake.run(lambda v: seen.append(v) or 1) == 2  # no attempts are left
    assert {r["id"] for r in intake.open().collect()} == {3, 5} and intake.good().count() == 3
    again = poison.Intake(source.unionByName(spark.createDataFrame([(6, "6")], "id long, v string")), "id", "v", "bigint", most=2, folder=intake.folder)
    assert again.run(strict) == 3 and again.good().where("id = 6").count() == 1 and again.good().count() == 4


def test_arrivals_are_all_rows_once(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    a = Arrivals(e, "event_id", 3)
    for part in range(3):
        a.add(part)
    assert sorted(map(tuple, spark.read.parquet(a.folder).collect())) == sorted(map(tuple, e.collect()))
    assert Arrivals(e.limit(0), "event_id", 2).stream().isStreaming


def test_redacted_documents_are_a_plain_replacement(spark):
    """Contact data of texts found and replaced by plain Python."""
    from quillspark.functions import privacy
    from quillspark.plans import texts

    rng = random.Random(9)
    words = ["a.b@c.org", "12x@y.de,", "X@y.de", "Tel: 0911 123456", "Matrikel: 1234 5678", "+49 911 1234567", "word", "noch ein Wort.", "Fax: 01.02.2024", "(a.b@c.org)", "1234 5678"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(14)))) for k in range(80)] + [(90, "")]

    def seeds(t):
        mail = [re.sub(r"^\d+(?=[A-Za-z][^@]*@)", "", x) for x in re.findall(privacy.EMAIL, t)]
        student = [x for x in (re.sub(r"[\s./-]+", "", y) for y in re.findall(privacy.STUDENT.replace("(?iu)", "(?i)"), t)) if len(x) >= 4]
        digits = lambda x: 7 <= len(re.sub(r"\D", "", x)) <= 16
        near = [x.strip() for x in re.findall(privacy.PHONE_LABELLED.replace("(?iu)", "(?i)"), t)]
        phone = [x for x in near if digits(x) and not re.search(privacy.DATE_LIKE, x)] + [x for x in (y.strip() for y in re.findall(privacy.PHONE_ABROAD, t)) if digits(x)]
        for kind, values in (("email", mail), ("student_id", student), ("phone", phone)):
            first = {}
            for v in values:
                first.setdefault(" ".join(v.split()).lower(), v)
            yield from ((kind, v, f"[{kind.upper()}_{n + 1:03d}]") for n, v in enumerate(first.values()))

    def plain(t):
        found = sorted(seeds(t), key=lambda s: -len(s[1]))
        taken, edits = set(), []
        for kind, v, new in found:
            left, right = privacy._EDGES[kind]
            for m in re.finditer(left + r"\s+".join(map(re.escape, v.split())) + right, t, re.I):
                if not taken & set(range(m.start(), m.end())):
                    taken |= set(range(m.start(), m.end()))
                    edits.append((m.start(), m.end(), new, kind))
        out = t
        for a, b, new, _ in sorted(edits, reverse=True):
            out = out[:a] + new + out[b:]
        return out, *(sum(e[3] == k for e in edits) for k in ("email", "phone", "student_id"))

    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        got = {r["document_id"]: (r["text"], r["n_email"], r["n_phone"], r["n_student_id"]) for r in texts.redacted_documents(spark, folder).collect()}
    assert got == {k: plain(t) for k, t in docs} and sum(x[1] > 0 for x in got.values()) > 20
