"""Operators that fit a model, and the remaining ones."""

import re
import textwrap
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, html_extraction, importance_resampling, license_scan, quotation, toxicity


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(1)
    vocab = [f"wort{k}" for k in range(300)]
    data, labels = [], []
    for i in range(900):
        w = list(rng.choice(vocab, 40))
        bad = i % 6 == 0
        if bad:
            w[3], w[9] = ("idiot", "moron") if i % 12 else ("zorbla" + w[1], "zorbli" + w[2])
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(data + [(1000, None), (1001, ""), (1002, "x" * 100_000)], "doc_id long, text string")
    out = toxicity.toxicity(docs, spark.createDataFrame(labels + [(5000, None)], "doc_id long, toxic int")).toPandas()
    held = out[out.held_out & (out.doc_id < 900)]
    truth = held.doc_id % 6 == 0
    assert len(out) == 903 and 0.2 < out.held_out.mean() < 0.45
    assert (held.predicted[truth] == 1).mean() > 0.9 and (held.predicted[~truth] == 1).mean() < 0.02
    assert out.score.between(0, 1).all() and not out.predicted[out.doc_id >= 1000].any()


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(k, "you are a stupid idiot" if k % 7 == 0 else f"fine text number {k}") for k in range(70)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, none).collect()}
    assert out[7] > out[8]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    kept = toxicity.keep_clean(docs.withColumn("key", F.lit("clash")), none)
    assert kept.columns == [*docs.columns, "key"] and 7 not in {r["doc_id"] for r in kept.collect()}


def test_flipped_labels_change_no_accuracy(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = [(i, " ".join(rng.choice([f"wort{k}" for k in range(50)], 20)) + (" idiot moron" if i % 9 == 0 else " stupid idiot scum" if i % 9 == 1 else "")) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    seen = []
    plain = toxicity.label_model

    def spy(*args, **how):
        seen.append(plain(*args, **how))
        return seen[-1]

    monkeypatch.setattr(toxicity, "label_model", spy)
    for share in (0.0, 0.05):
        flip = np.random.default_rng(1).random(600) < share
        toxicity.toxicity(docs, spark.createDataFrame([(i, int((i % 9 < 2) != flip[i])) for i in range(600)], "doc_id long, toxic int"))
    n = len(toxicity.FIXED)
    assert all(np.array_equal(x[:n], y[:n]) for x, y in zip(seen[0][:2], seen[1][:2], strict=True))


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One id has nearly all rows, with a text each, and a label."""
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("you stupid idiot number "), "id", F.lit(" goes on and on")).alias("text"))
    rows = rows.unionByName(spark.range(2000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("a clean text of a day "), "id").alias("text"))).unionByName(spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text")))
    labels = spark.createDataFrame([(1, 1), (7, 0), *[(100 + k, 0) for k in range(50)]], "doc_id long, toxic int")
    seen, features, stems = {}, toxicity._features, toxicity.find_stems
    monkeypatch.setattr(toxicity, "_features", lambda few, s: (seen.update(rows=few.count()), features(few, s))[1])
    monkeypatch.setattr(toxicity, "find_stems", lambda few, rate: (seen.update(stems=few.count()), stems(few, rate))[1])
    toxicity.fit(toxicity.c.identified(rows, "doc_id", "text"), labels, sample=500)
    assert 100 < seen["rows"] <= 1000 and 0 < seen["stems"] <= 1500
    vectors = spark.range(20_000).select(F.lit(50).cast("long").alias("vec_id"), F.array(*[F.rand(k).cast("float") for k in range(4)]).alias("embedding"))
    kept = {}
    train = ann.train
    monkeypatch.setattr(ann, "train", lambda x, lists, seed=7: (kept.update(n=len(x)), train(x, lists, seed))[1])
    ann.neighbours(vectors, every=7, sample=300)
    assert 100 < kept["n"] <= 600


def test_toxicity_awkward_rows(spark):
    texts = [(1, "you stupid idiot"), (1, "fine words here"), (1, "you stupid idiot"), (None, "you stupid idiot"), (None, None), (2, ""), (3, "idiot " * 50_000)] + [(k, f"fine text number {k}") for k in range(10, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({x: F.lit("clash") for x in ("key", "tie", "row", "toxic", "score", "a.b")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (10, 0), (11, None), (None, 1), (12, 7)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 for r in out)
    by = defaultdict(set)
    for r in out:
        by[r["doc_id"]].add(round(r["score"], 12))
    assert len(by[1]) == 2 and max(by[1]) in by[None] and by[2] <= by[None]
    kept = toxicity.keep_clean(docs, labels, least=min(by[1]))
    assert kept.columns == docs.columns and kept.where("score = 'clash'").count() == kept.count() < len(texts)


def test_label_model_finds_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(200_000) < 0.2
    v = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in ((0.6, 0.02), (0.5, 0.05), (0.7, 0.1), (0.4, 0.02), (0.5, 0.03))], 1)
    v = np.concatenate([v, v[:, 1:2] ^ (rng.random((len(y), 1)) < 0.01)], 1).astype(float)
    p1, p0, tied = toxicity.label_model(len(v), v.T @ v, 0.2)
    assert tied[1, 5] and tied[5, 1] and not tied[0].any()
    assert np.allclose(p1[[0, 2, 3, 4]], [0.6, 0.7, 0.4, 0.5], atol=0.08) and np.allclose(p0[[0, 2, 3, 4]], [0.02, 0.1, 0.02, 0.03], atol=0.03)


@pytest.mark.parametrize("n", [3, 700])
def test_ann_recall_and_exact_scores(spark, n):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 24)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] * 24), (n + 3, [None] * 24), (n + 4, x[1].tolist()), (n + 5, [1.0])]
    out = ann.neighbours(spark.createDataFrame(data, "vec_id long, embedding array<float>")).toPandas()
    full = np.concatenate([x, x[1:2]]).astype(float)
    ids = np.array([*range(n), n + 4])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    right = total = 0
    for q in range(0, n, 50):
        s = unit @ unit[q]
        best = [int(j) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != q][:5]
        got = out[out.query_id == q].sort_values("rank")
        assert list(got["rank"]) == list(range(1, min(5, n) + 1))
        assert np.allclose(got.score, [unit[q] @ unit[list(ids).index(v)] for v in got.vec_id])
        right += len(set(got.vec_id) & set(ids[best]))
        total += len(best)
    assert right / total >= 0.9
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ann_ranks_copies_and_near_copies_exactly(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2, 24))
    x = np.concatenate([rng.normal(size=(400, 24)), np.repeat(base[:1], 700, 0), base[1] + 1e-3 * rng.normal(size=(1000, 24))]).astype(np.float32)
    ids = rng.permutation(len(x))
    out = ann.neighbours(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    copies = np.sort(ids[400:1100])
    asked = {"copies": 0, "near": 0}
    for at in np.flatnonzero(ids % 50 == 0):
        got = list(out[out.query_id == ids[at]].sort_values("rank").vec_id)
        if 400 <= at < 1100:
            asked["copies"] += 1
            assert got == [i for i in copies if i != ids[at]][:5]
        elif at >= 1100:
            asked["near"] += 1
            s = unit @ unit[at]
            s[at] = -2
            assert set(got) == set(ids[np.argsort(-s)[:5]])
    assert min(asked.values()) > 5


def brute_neighbours(x, ids, q, k=5):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = unit @ unit[q]
    return [int(ids[j]) for j in np.lexsort((ids, -s)) if j != q][:k]


@pytest.mark.parametrize("clustered", [True, False])
def test_ann_probes_some_lists_only(spark, clustered):
    rng = np.random.default_rng(6)
    n, d = 10_000, 32
    x = rng.normal(size=(n, d)).astype(np.float32)
    if clustered:
        x = (0.25 * x + rng.normal(size=(200, d))[rng.integers(0, 200, n)]).astype(np.float32)
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    out = ann.neighbours(df, size=500, rerank=50).toPandas()
    right = [len(set(out.vec_id[out.query_id == ids[q]]) & set(brute_neighbours(x, ids, q))) for q in np.flatnonzero(ids % 50 == 0)]
    assert len(right) == 200 and sum(right) >= 0.9 * 5 * len(right) and (out.groupby("query_id").size() == 5).all()
    if clustered:  # a few of the hundred lists do
        few = ann.neighbours(df, probes=8).toPandas()
        right = [len(set(few.vec_id[few.query_id == ids[q]]) & set(brute_neighbours(x, ids, q))) for q in np.flatnonzero(ids % 50 == 0)]
        assert sum(right) >= 0.9 * 5 * len(right)


def test_ann_awkward_rows(spark):
    tiny = [2.0**-700 * k for k in range(1, 5)]
    data = [(0, [1.0, 2.0, 3.0, 4.0]), (0, [4.0, 3.0, 2.0, 1.0]), (0, [1.0, 2.0, 3.0, 4.0]), (1, tiny), (2, [1e200, 0.0, 0.0, 0.0]), (50, [1.0, 1.0]), (3, [1.0, 0.9]), (None, [1.0, 1.0]), (4, []), (5, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("tie", F.lit("clash")).withColumn("list", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.neighbours(df).collect()]
    near, far, one = round(20 / 30, 9), round(1 / 30**0.5, 9), round(1.9 / (2 * 1.81) ** 0.5, 9)
    assert sorted(got) == sorted(
        [(0, 1, 1, 1.0), (0, 2, 5, 1.0), (0, 3, 0, near), (0, 4, 2, far)] + [(0, 1, 2, round(4 / 30**0.5, 9)), (0, 2, 0, near), (0, 3, 1, near), (0, 4, 5, near)] + [(50, 1, 3, one)]
    )


def test_resampling_prefers_the_target(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"g{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    data = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good, 30))) for i in range(400)] + [(400, None), (401, "")]
    target = spark.createDataFrame([(i,) for i in range(1, 400, 2) if i % 5], "doc_id long")
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = importance_resampling.resample(docs, target, share=0.8).toPandas()
    assert len(out) == 402 and out.kept.sum() == round(0.8 * 402)
    assert not out.kept[(out.doc_id % 5 == 0) & (out.doc_id < 400)].any()
    assert out.key_value[out.kept].min() > out.key_value[~out.kept].max()
    assert importance_resampling.resample(docs, target.limit(0), share=0.5).where("kept").count() == 201
    assert importance_resampling.resample(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("sample", [None, 10_000])
def test_resampling_is_brute_force(spark, sample):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)] + ["!!", "...", "a,b", "(é)"]
    data = [(i, " ".join(rng.choice(words, int(rng.integers(1, 40))))) for i in range(200)] + [(200, None), (200, "w1 w2"), (None, "w1 w2"), (None, None), (None, "w1 w2"), (201, "w5 " * 60_000), (202, "")]
    good = {i for i in range(0, 200, 3)} | {200}
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("good", F.lit("clash"))
    target = spark.createDataFrame([(i,) for i in good] + [(None,)], "doc_id long")
    out = importance_resampling.resample(docs, target, share=0.5, sample=sample).collect()

    def grams(text):
        t = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", (text or "").lower())]
        return t + list(zip(t, t[1:], strict=False))

    slot = {g: None for _, text in data for g in grams(text)}
    for g in slot:  # of a text that is the gram alone
        raw = (g if isinstance(g, bytes) else b" ".join(g))
        slot[g] = int(importance_resampling._slots(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1][-1])
    raw, own = np.ones(importance_resampling.SLOTS), np.ones(importance_resampling.SLOTS)
    for i, text in data:
        for g in grams(text):
            raw[slot[g]] += 1
            own[slot[g]] += i in good
    ratio = np.log(own / own.sum()) - np.log(raw / raw.sum())
    want = sorted(((i, round(float(sum(ratio[slot[g]] for g in grams(text))), 5)) for i, text in data), key=str)
    assert sorted(((r["doc_id"], round(r["log_weight"], 5)) for r in out), key=str) == want
    assert sum(r["kept"] for r in out) == round(0.5 * len(data))
    assert min(r["key_value"] for r in out if r["kept"]) >= max(r["key_value"] for r in out if not r["kept"])


def test_kth_largest_among_ties(spark):
    rows = spark.createDataFrame([(float(k // 10),) for k in range(500)] + [(7.0,)] * 300, "x double")
    values = sorted((r[0] for r in rows.collect()), reverse=True)
    for k in (1, 9, 400, 500, 800):
        assert importance_resampling.kth_largest(rows, "x", k, room=5) == values[k - 1]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- note --><div id=page><h1>The &eacute;vent</h1>
<div class="content"><p>First, a long paragraph, with some commas,
 that goes on for a while.<p><b>Second &amp; open<br>line<p>Third with <a href=x>link</a>, yes.<div class="cookie-notice">Cookies, ok, fine, yes?</div></div>
<form><p>Search, for, it</p></form><aside><p>Side, text, here, long.</p></aside><section id="comments"><p>Nice, post, thanks, a, lot.</p></section></div><footer>&copy; x</footer>"""


def test_main_text():
    assert html_extraction.main_text(PAGE) == "The évent\n\nFirst, a long paragraph, with some commas, that goes on for a while.\n\nSecond & open line\n\nThird with link, yes."
    assert [html_extraction.main_text(x) for x in (None, "", "<p>", "<!-- open", "<a", "a < b &lt; c")] == ["", "", "", "", "<a", "a < b < c"]
    wrapped = '<div class="layout has-sidebar"><div class="site-header">Top, of, it</div><div class="post-header"><h1>Head</h1></div><div class="entry overflow-hidden"><p>Long, first, paragraph of the text, which goes on.</p><article class="comment"><p>Nice, one, here.</p></article></div></div>'
    assert html_extraction.main_text(wrapped) == "Head\n\nLong, first, paragraph of the text, which goes on."
    assert html_extraction.main_text("<form><p>All in a form.</p></form>") == "All in a form."
    assert len(html_extraction.main_text("<div>" * 3000 + "deep" + "<p>" + "word, " * 50_000)) > 200_000


def test_linked_headings_and_paragraphs_stay():
    long = "Long, first, paragraph of the text, which goes on, and on, for a while."
    page = f'''<article><h1><a href=x>Linked headline</a></h1><p>{long}</p><h2><a href=y>Linked section</a></h2><p><a href=z>One link alone</a></p>
<ul><li><a href=1>List one</a><li><a href=2>List two</a><li><a href=3>List three</a></ul>
<div class="x"><h3>More</h3><ul><li><a href=1>Menu one of links</a><li><a href=2>Menu two of links</a><li><a href=3>Menu three of links</a></ul></div>
<ol class="references"><li><a href=4>Source one</a><li><a href=5>Source two</a><li><a href=6>Source three</a></ol>
<ul><li>A longer item of the list, in words, and <a href=7>its link</a><li><a href=8>Link only</a><li>Another item of words without a link in it</ul></article>'''
    want = ["Linked headline", long, "Linked section", "One link alone", "List one", "List two", "List three", "Source one", "Source two", "Source three", "A longer item of the list, in words, and its link", "Link only", "Another item of words without a link in it"]
    assert html_extraction.main_text(page).split("\n\n") == want


@pytest.mark.parametrize("odd", ['<svg class="i"/>', "<svg/>", "<math/>", "<svg><title/><path d='M0'/></svg>", "<svg><path d='M0'>", "<select><option>No<option>No</select>", "<template><p>No</template>", "<video>No</video>", "<canvas><div>No</div></canvas>"])
def test_page_goes_on_after_embedded_elements(odd):
    long = "Long, first, paragraph of the text, which goes on, and on, for a while."
    assert html_extraction.main_text(f"<article><div>{odd}</div><p>{long}</p></article>") == long
    assert html_extraction.main_text(f"<article><p>Before {odd}</p><p>{long}</p></article>") == f"Before\n\n{long}"
    assert html_extraction.main_text(f"<article><div><object>No</div><p>{long}</p></article>") == long


@pytest.mark.parametrize(
    "box,stays",
    [("advert no-print", False), ("sidebar with-border", False), ("has-sidebar", True), ("no-menu", True), ("share-price", True), ("share-buttons", False), ("social-share", False), ("notice", False), ("related-posts", False), ("related-work", True), ("response-rate", True), ("commentary", True), ("post-comments", False)],
)
def test_names_of_boxes(box, stays):
    long = "Long, first, paragraph of the text, which goes on, and on, for a while."
    page = f'<article><p>{long}</p><div class="{box}"><p>Box of some words.</p></div><p>{long}</p></article>'
    assert main_text(page).split("\n\n") == ([long, "Box of some words.", long] if stays else [long, long])


def main_text(page):
    return html_extraction.main_text(page)


ARTICLE = "<h1>Head</h1><p>Long, first, paragraph of the text, which goes on, and on, for a while, and says things.</p><p>Second, long, paragraph of the text, with many words in it, and some commas.</p>"
READ = "Head\n\nLong, first, paragraph of the text, which goes on, and on, for a while, and says things.\n\nSecond, long, paragraph of the text, with many words in it, and some commas."
AROUND = '<div class="sidebar"><p>Side text, of some words, here.</p></div><div class="entry">%s</div><div id="comments"><p>Nice, post, thanks, a lot of it.</p></div>'


@pytest.mark.parametrize("inner", ["%s", "<article>%s</article>", "<main>%s</main>", AROUND])
@pytest.mark.parametrize(
    "name",
    ["content-sidebar-wrap", "site sidebar-right", "layout-with-sidebar", "page-with-sidebar", "post-container promo", "comments-enabled", "ad-free", "menu-open", "modal-open", "newsletter-article", "story-body popup", "single-post cookie-consent-given", "breadcrumb-page", "wrapper footer-fixed"],
)
def test_names_of_wrappers_hide_no_article(name, inner):
    for tag in ("div", "section"):
        assert main_text(f'<html><body><div>Site name</div><{tag} class="{name}">{inner % ARTICLE}</{tag}><footer>x</footer></body></html>') == READ
        assert main_text(f'<body><div>Site name</div><{tag} id="outer"><{tag} class="{name}"><div class="modal menu">{inner % ARTICLE}</div></{tag}></{tag}>') == READ


def test_forms_around_pages_and_comments_longer_than_articles():
    links = "<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul>"
    assert main_text(f"<body><div>Site name</div><form id=aspnetForm><div>{ARTICLE}</div></form>") == READ
    assert main_text(f"<body><article>{ARTICLE}<form><p>{'Search, for, it, ' * 30}</p></form><h2>See also</h2>{links}</article>") == READ + "\n\nSee also\n\none\n\ntwo\n\nthree"
    talk = "".join(f"<li><p>{'Nice, post, thanks, a lot. ' * 20}</p>" for _ in range(20))
    assert main_text(f'<body><div class="entry">{ARTICLE}</div><ol class="commentlist">{talk}</ol>') == READ
    assert main_text(f'<body><div class="entry">{ARTICLE}</div><section id="comments"><article><p>{"Nice, post. " * 90}</p></article></section>') == READ
    assert main_text("") == main_text('<div class="ad"></div>') == ""


class Node:
    def __init__(self, tag, up):
        self.tag, self.up, self.parts = tag, up, []


def plain_main_text(html):
    """A slow, plain scorer for well-formed pages without doubted wrappers."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at = self.root = Node("#", None)

        def handle_starttag(self, tag, attrs):
            node = Node(tag, self.at)
            node.named = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            self.at.parts.append(node)
            if tag not in html_extraction.VOID:
                self.at = node

        def handle_endtag(self, tag):
            self.at = self.at.up

        def handle_data(self, data):
            self.at.parts.append(data)

    reader = Reader()
    reader.feed(html)
    skip = {"script", "style", "title", "noscript", "svg", "form", "nav", "footer", "head"}
    noise = {"advert", "sidebar", "cookie-notice", "comments", "widget menu"}
    blocks = []  # (node, text, linked share)

    def read(node, pieces):
        def flush():
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                blocks.append((node, text, min(1.0, sum(len(t.strip()) for t, linked in pieces if linked) / len(text))))
            pieces.clear()

        for part in node.parts:
            if isinstance(part, str):
                pieces.append((part, False))
            elif part.tag in skip or part.tag == "header" or part.named in noise:
                flush() if part.tag in html_extraction.BLOCK and part.tag not in skip else None
            elif part.tag == "a":
                pieces.append(("".join(x for x in part.parts), True))
            else:
                flush()
                read(part, [])
        flush()

    read(reader.root, [])
    up = lambda n, k: n if k == 0 or n is None else up(n.up, k - 1)
    score, size, linked = {}, {}, {}
    for node, text, share in blocks:
        points = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - share)
        first = node.up if node.tag in html_extraction.PARAGRAPH else node
        for level, weight in enumerate((1, 1 / 2, 1 / 3, 1 / 6, 1 / 9)):
            if up(first, level) is not None:
                score[up(first, level)] = score.get(up(first, level), 0) + points * weight
        while node is not None:
            size[node], linked[node] = size.get(node, 0) + len(text), linked.get(node, 0) + share * len(text)
            node = node.up
    bonus = {"article": 25, "main": 15, "div": 5, "section": 5, "td": 3}
    final = {n: (s + bonus.get(n.tag, 0)) * (1 - linked[n] / size[n]) for n, s in score.items() if n.tag not in html_extraction.PARAGRAPH | html_extraction.LISTS}
    best = max(final, key=final.get)
    for n in iter(lambda n=[best]: n.__setitem__(0, n[0].up) or n[0], None):
        if n.tag in ("article", "main"):
            best = n
            break
    kept = {best}
    if best.tag not in ("article", "main", "body", "html", "#"):
        for n in size:
            if n.up is best.up:
                share = linked[n] / size[n]
                if final.get(n, 0) >= max(10, 0.2 * final[best]) or n.tag in html_extraction.BESIDE and share < 0.25 and (size[n] > 80 or not share):
                    kept.add(n)
    inside = lambda n: n is not None and (n in kept or inside(n.up))
    return "\n\n".join(text for n, text, _ in blocks if inside(n))


def test_scores_are_those_of_a_plain_scorer():
    """Articles in ``div``, ``main``, ``article`` and tables, beside menus and boxes."""
    rng, word = np.random.default_rng(5), "alpha beta gamma, delta end.".split()
    text = lambda n: " ".join(rng.choice(word, n))
    for _ in range(300):
        body = "".join(f"<p>{text(rng.integers(20, 60))} <a href='x'>{text(2)}</a></p>" if rng.random() < 0.5 else f"<div><p>{text(rng.integers(20, 60))}</p></div>" for _ in range(rng.integers(3, 8)))
        wrap = [("<article>", "</article>"), ("<div class='post'>", "</div>"), ("<main>", "</main>"), ("<table><tr><td>", "</td></tr></table>")][rng.integers(4)]
        other = "".join(f"<div class='{rng.choice(['sidebar', 'advert', 'cookie-notice'])}'><p>{text(20)}</p></div>" for _ in range(rng.integers(3)))
        page = f"<html><body><nav><ul><li><a href='y'>{text(3)}</a></li></ul></nav>{other}{wrap[0]}{body}{wrap[1]}<footer><p>{text(9)}</p></footer></body></html>"
        assert main_text(page) == plain_main_text(page), page


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    for tag in ("div", "span", "b", "li", "svg", "p", "table", "section"):
        assert "deep" in main_text(f"<{tag}>" * 100_000 + "deep, text" + "</i>" * 1000) or tag == "svg"
    assert time.perf_counter() - began < 30


def random_page(rng):
    """A page and the blocks of its article."""
    word = lambda: str(rng.choice("alpha beta gamma delta café naïve x&y <b> 1,000 end.".split()))
    text = lambda n: " ".join(word() for _ in range(n))
    written = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;" if rng.random() < 0.5 else "é").replace(" ", str(rng.choice([" ", "\n", "  \t"])))
    blocks, body = [], []
    for _ in range(rng.integers(4, 12)):
        kind = rng.choice(["p", "p", "p", "p", "h2", "li", "quote", "linked", "noise"])
        if kind == "noise":
            body.append(str(rng.choice(["<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", '<div class="advert"><p>Buy, this, now.</p></div>', "<form><p>Name</p><input></form>", "<noscript><p>no</p></noscript>", "<svg><path d='M0'/></svg>"])))
            continue
        made = [text(rng.integers(25, 60)) for _ in range(rng.integers(1, 3) if kind == "li" else 1)] if kind != "h2" else [text(4)]
        blocks += made
        inside = [written(x) for x in made]
        if kind == "linked":
            head, _, tail = inside[0].partition(" ")
            inside = [f'<a href="/x">{head}</a> {tail}']
        body.append({"p": "<p>%s</p>", "h2": "<h2>%s</h2>", "li": "<ul>%s</ul>", "quote": "<blockquote><p>%s</p></blockquote>", "linked": "<p>%s"}[kind] % ("".join(f"<li>{x}" for x in inside) if kind == "li" else inside[0]))
    wrap = [("<article>", "</article>"), ('<div class="post"><div class="entry">', "</div></div>"), ("<main><section>", "</section></main>"), ('<table><tr><td class="c">', "</td></tr></table>")][rng.integers(4)]
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{text(2)}</a></li>' for k in range(6)) + "</ul>"
    parts = [f"<header><h1>{text(2)}</h1></header>", f"<nav>{menu}</nav>", f'<div id="sidebar"><p>{text(30)}</p></div>', f'<div class="cookie-notice"><p>{text(12)}</p></div>']
    after = [f'<section id="comments"><p>{text(20)}</p></section>', f"<footer><p>{text(10)}</p></footer>", f'<div class="widget menu">{menu}</div>']
    some = lambda x: "".join(y for y in x if rng.random() < 0.7)
    page = f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{some(parts)}{wrap[0]}{''.join(body)}{wrap[1]}{some(after)}</body></html>"
    return page, "\n\n".join(" ".join(x.split()) for x in blocks)


def test_articles_come_back_from_their_pages():
    rng = np.random.default_rng(8)
    pages = [random_page(rng) for _ in range(400)]
    wrong = [(page, want, got) for page, want in pages if (got := main_text(page)) != want]
    assert not wrong, wrong[0]


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extraction.extract(pages).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[1]["text"].startswith("The évent") and got[2]["text"] == "" and got[2]["n_chars"] == 0
    assert html_extraction.extract(pages.limit(0)).count() == 0
    twice = html_extraction.extract(pages.unionByName(pages).withColumn("a.b", F.lit(1)))
    assert twice.count() == 4 and twice.distinct().count() == 2 and "a.b" in twice.columns


def test_quotations_link_messages(spark):
    data = [
        (1, 0, "u", "Hello there everybody. I have a question about Spark joins!"),
        (1, 1, "a", "On Monday X wrote:\n> I have a question about  spark joins\nSure, ask it then please."),
        (1, 2, "u", "> Sure, ask it then please.\n> > I have a question about Spark joins!\nHow do they work exactly?"),
        (2, 0, "u", "> How do they work exactly?\nI wonder about this as well."),
        (2, 1, None, None), (3, 0, "u", "> unknown passage here\nok"), (None, 4, "u", "> Sure, ask it then please."),
    ]
    messages = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in quotation.link(messages).collect()}
    assert len(got) == 7
    assert [(got[k]["parent_conv"], got[k]["parent_turn"], got[k]["depth"]) for k in ((1, 0), (1, 1), (1, 2), (2, 0))] == [(None, None, 0), (1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert got[1, 1]["body"] == "Sure, ask it then please." and got[1, 2]["n_quoted"] == 2 and got[2, 1]["body"] == ""
    assert (got[2, 0]["branch_conv"], got[2, 0]["branch_turn"]) == (1, 0)
    assert quotation.link(messages.limit(0)).count() == 0
    assert quotation.link(messages.unionByName(messages)).count() == 14


def test_short_and_wrapped_quotations_link(spark):
    data = [
        (1, 0, "u", "Yes."), (1, 1, "a", "> Yes.\nFine then."),
        (2, 0, "u", "Shall we go on with the plan of yesterday, or wait\nfor the others to come back?\n\nThanks!"),
        (2, 1, "a", "> Shall we go on with the plan\n> of yesterday, or wait for the others\n> to come back?\nLet us wait."), (2, 2, "u", "> Thanks!\nWelcome."),
        (3, 0, "u", "今日は。\n明日、会議が\nあります。"), (3, 1, "a", "> 今日は。\nはい"), (3, 2, "u", "> 明日、会議があります。\n了解"),
        (4, 0, "u", "> Yes.\nNo such message in here."), (4, 1, "u", "first item of it\nsecond item of it\nthird item of it"), (4, 2, "u", "> first item of it\n> third item of it\nBoth."),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotation.link(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    up = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items() if r["parent_conv"]}
    assert up == {(1, 1): (1, 0), (2, 1): (2, 0), (2, 2): (2, 0), (3, 1): (3, 0), (3, 2): (3, 0), (4, 2): (4, 1)}
    assert got[2, 1]["n_quoted"] == got[2, 1]["n_linked"] == 1


def test_common_phrases_link_no_other_conversation(spark):
    long = "The build of the second branch fails since the parser was moved."
    data = [
        (1, 0, "u", "Thanks a lot!\nSee you then.\nOr on Monday."), (9, 1, "a", "> Thanks a lot!\nYou are welcome."), (10, 1, "a", "> Thanks a lot!\n> See you then.\nFine."), (11, 1, "a", "> Thanks a lot!\n> Thanks a lot!\nFine."),
        (2, 0, "u", long), (12, 0, "a", f"> {long}\nI see."), *[(20 + k, 0, "u", "We look forward to hearing from you again soon.") for k in range(5)], (30, 0, "a", "> We look forward to hearing from you again soon.\nHm."),
    ]
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in quotation.link(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect() if r["parent_conv"]}
    assert got == {(10, 1): (1, 0), (12, 0): (2, 0)}


def brute_links(messages):
    """Parent, branch and depth of each (conversation, turn), by the definition."""
    own, quoted = defaultdict(set), defaultdict(set)
    for conv, turn, _, text in messages:
        _, mine, asked, _ = quotation.parse(text)
        own[conv, turn] |= set(mine)
        quoted[conv, turn] |= {tuple(q.values()) for q in asked}
    up = {}
    for at in sorted(own):
        to, others = defaultdict(set), []
        for level, sentence, h, whole, far in quoted[at]:
            near = [x for x in own if x[0] == at[0] and x[1] < at[1] and h in own[x]]
            owners = [x for x in own if h in own[x]]
            first = min(owners, default=None)
            if near:
                to[level, sentence].add((whole, True, max(near)))
            elif far and first and first < at and first[0] != at[0]:
                others.append((level, sentence, whole, first, far == 2 and len({x[0] for x in owners}) <= quotation.RARE))
        for level, sentence, whole, first, alone in others:
            if alone or len({x[1] for x in others if x[3] == first}) > 1:
                to[level, sentence].add((whole, False, first))
        votes = Counter((level, max(x)[2]) for (level, _), x in to.items())
        if votes:
            up[at] = min(votes, key=lambda v: (v[0], -votes[v], -v[1][1], -v[1][0]))[1]
    out = {}
    for at in own:
        top, depth = at, 0
        while top in up:
            top, depth = up[top], depth + 1
        out[at] = (up.get(at), top, depth)
    return out


def test_links_are_brute_force(spark):
    rng = np.random.default_rng(9)
    said = [f"{a} {b}{' and so on we go' * (k % 2)} {k}." for k, (a, b) in enumerate(zip(rng.choice("Yes No Perhaps We should go on with that".split(), 100), rng.choice("then now indeed as a matter of fact".split(), 100), strict=True))] + ["Yes.", "No!", "A very common first line of all."]
    messages = []
    for conv in range(45):
        lines = []
        for turn in range(int(rng.integers(1, 8))):
            quote = [">" * int(rng.integers(1, 3)) + " " + x for x in rng.choice(said, int(rng.integers(0, 6)))]
            body = ["A very common first line of all."] * (turn == 0) + list(rng.choice(said, int(rng.integers(1, 4))))
            lines = quote + body if rng.random() < 0.8 else body + quote
            messages.append((conv, turn, "u", "\n".join(lines)))
    messages += [(131, 0, "u", "word " * 100_000 + "end."), (131, 1, "a", "> " + "word " * 100_000 + "end.\nLong."), (None, 1, "u", "> Yes."), (3, None, "u", "> Yes.")]
    got = quotation.link(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("h", F.lit("clash")).withColumn("own", F.lit("clash"))).collect()
    assert len(got) == len(messages)
    want = brute_links([m for m in messages if None not in m[:2]])
    assert sum(x[0] is not None for x in want.values()) > 50
    place = lambda conv, turn: None if conv is None else (conv, turn)
    for r in got:
        if None not in (r["conv_id"], r["turn"]):
            assert (place(r["parent_conv"], r["parent_turn"]), (r["branch_conv"], r["branch_turn"]), r["depth"]) == want[r["conv_id"], r["turn"]]
    order = sorted((r for r in got if None not in (r["conv_id"], r["turn"])), key=lambda r: (r["branch_conv"], r["branch_turn"], r["depth"], r["conv_id"], r["turn"]))
    seen = set()
    for r in order:
        assert r["parent_conv"] is None or (r["parent_conv"], r["parent_turn"]) in seen
        seen.add((r["conv_id"], r["turn"]))


def test_long_chain_of_replies(spark):
    data = [(7, k, "u", (f"> passage of number {k - 1} stands here\n" if k else "") + f"passage of number {k} stands here") for k in range(40)]
    got = {r["turn"]: r for r in quotation.link(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert all(r["depth"] == k and r["branch_turn"] == 0 for k, r in got.items())


def test_full_licence_texts_and_wrapped_headers(spark):
    full = lambda name: (Path(license_scan.__file__).parent / "licences" / f"{name}.txt").read_text()
    head = "".join(f" * {x}\n" for x in textwrap.wrap(full("GPL-2.0.header"), 50))
    files = [
        (1, "m/LICENSE", "The MIT License\n\nCopyright (c) 2020 Some One\n\n" + full("MIT")), (2, "m/src/x.py", "print(1)"), (3, "g/COPYING", full("GPL-3.0")), (4, "g/a/y.c", "int x;"),
        (5, "b/legal.txt", "Copyright 2019 Firm X\n" + full("BSD-3-Clause")), (6, "b/z.c", ""), (7, "h/w.c", "/*\n" + head + " */\n" + "int value = compute(value);\n" * 200),
        (8, "p/prose.txt", "The permission of the owner is a thing of which we speak in this text, and for the sake of it. " * 20), (9, "a/LICENSE", full("Apache-2.0")), (10, "a/b/c/v.c", None),
    ]
    got = {r["file_id"]: (r["license"], r["origin"], r["from_dir"]) for r in license_scan.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "m"), 3: ("GPL-3.0", "file", None), 4: ("GPL-3.0", "inherited", "g"), 5: ("BSD-3-Clause", "file", None), 6: ("BSD-3-Clause", "inherited", "b"),
        7: ("GPL-2.0", "header", None), 8: (None, "none", None), 9: ("Apache-2.0", "file", None), 10: ("Apache-2.0", "inherited", "a"),
    }


def test_identifiers_named_licences_and_long_lines(spark):
    zlib = (Path(license_scan.__file__).parent / "licences" / "Zlib.txt").read_text()
    code, words = "int value = compute(value);\n" * 60, " ".join(f"word{k}" for k in range(300))
    files = [
        (1, "a/x.c", "/* SPDX-License-Identifier: GPL-2.0-only */\n" + code), (2, "a/y.c", "// SPDX-License-Identifier: BSD-2-Clause\n" + code), (3, "a/z.c", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */\n" + code),
        (4, "a/w.c", "# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0)\n" + code), (5, "a/u.c", "# SPDX-License-Identifier: Of-No-List\n" + code), (6, "b/LICENSE", "MIT"), (7, "b/c/q.c", code), (8, "d/LICENSE", zlib), (9, "d/e.c", code),
        (10, "e/LICENSE.txt", "Zlib License\n"), (11, "f/LICENSE", "unheard"), (12, "g/l.txt", f"{words} Released under the MIT License. {words}"), (13, "g/m.txt", f"{words} and this text is released under the MIT License as {words}"), (14, "g/mit.txt", "MIT"),
        (15, "h/k.c", "// This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0\n" + code), (16, "h/j.c", "// Distributed under the Boost Software License, Version 1.0.\n" + code),
    ]
    got = {r["file_id"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got == {
        1: ("GPL-2.0-only", "header"), 2: ("BSD-2-Clause", "header"), 3: ("MIT OR Apache-2.0", "header"), 4: ("(GPL-2.0-or-later WITH Classpath-exception-2.0)", "header"), 5: (None, "none"), 6: ("MIT", "file"), 7: ("MIT", "inherited"),
        8: ("Zlib", "file"), 9: ("Zlib", "inherited"), 10: ("Zlib", "file"), 11: (None, "none"), 12: ("MIT", "header"), 13: (None, "none"), 14: (None, "none"), 15: ("EPL-2.0", "header"), 16: ("BSL-1.0", "header"),
    }


def test_licences_are_inherited_by_path(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code\n" * 50),
        (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "z/q.py", None), (6, None, "All rights reserved"), (7, "top.py", ""), (8, "a/w.py", "license of another kind entirely unknown words"),
    ]
    df = spark.createDataFrame(files, "file_id long, path string, text string").withColumn("line", F.lit("clash"))
    got = {r["file_id"]: (r["license"], r["origin"], r["from_dir"]) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "file", None),
        5: (None, "none", None), 6: ("Proprietary", "file", None), 7: (None, "none", None), 8: ("MIT", "inherited", "a"),
    }
    assert license_scan.scan(df.limit(0)).count() == 0
    more = [(1, "x/y.py", "code"), (1, "w/z.py", "Released under the MIT License."), (None, "w/q.py", None), (None, "v/LICENSE", "license " + "word " * 100_000), (9, "m/long.py", "Released under the MIT License. " + "permission " * 50_000)]
    wide = license_scan.scan(spark.createDataFrame(more, "file_id long, path string, text string").withColumn("h", F.lit("clash")).withColumn("file", F.lit("clash")))
    assert sorted((r["path"], r["license"], r["origin"]) for r in wide.collect()) == [("m/long.py", "MIT", "header"), ("v/LICENSE", None, "none"), ("w/q.py", "MIT", "inherited"), ("w/z.py", "MIT", "file"), ("x/y.py", None, "none")]
    assert license_scan.scan(df.unionByName(df)).count() == 16
