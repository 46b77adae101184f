"""Lexical search, hard negatives and shards against brute force, on awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives, lexical_search, sharding

# -- lexical search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_rank(docs, items, k):
    docs = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_all, total = len(docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for i, c, n in docs:
            m = 25 + 75 * n * n_all // total
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


WORDS = [f"w{(k * 7919) % 977}" for k in range(300)]
RNG = np.random.default_rng(3)
TEXTS = [" ".join(RNG.choice(WORDS[t * 40 : t * 40 + 120], int(n))) for t, n in zip(RNG.integers(0, 4, 500), RNG.integers(1, 60, 500), strict=True)]
DOCS = [(k, t) for k, t in enumerate(TEXTS)] + [
    (900, None), (901, ""), (902, " .,; "), (None, TEXTS[0]), (None, TEXTS[1] + " extra"), (903, " ".join(WORDS) * 40), (904, "Straße ÉCOLE école i18n w1 W1"), (904, "other w1"), (905, "q" * 5000),
    *[(1000 + k, "same words here w1 w2") for k in range(150)], (7, "same words here w1 w2"), (3, TEXTS[3]), (3, TEXTS[3]),
]
ITEMS = [(1, "w1 w2 same"), (2, TEXTS[9]), (3, None), (4, "..."), (5, "école École ÉCOLE strasse Straße"), (6, "none of these stand anywhere"), (7, " ".join(TEXTS[:20])), (8, "w1 w1 w1 w2"), (8, "w1 w1 w1 w2"), (8, "w3"), (None, "w1 words"), (9, "q" * 5000)]


@pytest.mark.parametrize("how", ["plain", "blocks", "all terms", "small groups"])
def test_rank_is_brute_force(spark, monkeypatch, how):
    for name, value in {"blocks": [("BLOCK", 2), ("FIRST", 1)], "all terms": [("WORDS", 3), ("SAMPLE", 64), ("EDGES", 4)], "small groups": [("GROUP", 40), ("LEAF", 16), ("SAMPLE", 200)]}.get(how, []):
        monkeypatch.setattr(lexical_search, name, value)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("terms", F.lit(1)).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("tie", F.lit("clash"))
    got = sorted(map(tuple, lexical_search.rank(docs, items, k=7).collect()), key=str)
    assert got == brute_rank(DOCS, ITEMS, 7)


def test_rank_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS[:5], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.rank(docs.limit(0), items).count() == 0
    assert lexical_search.rank(docs, items.limit(0)).count() == 0
    assert lexical_search.rank(docs.where("false"), items.where("false")).count() == 0


def test_bisection_keeps_every_document_and_shortens_gaps():
    rng = np.random.default_rng(1)
    topic = rng.integers(0, 4, 512)
    words = [np.unique(rng.choice(np.arange(t * 50, t * 50 + 60), 20)) for t in topic]
    doc, term = np.repeat(np.arange(512), list(map(len, words))), np.concatenate(words)
    leaves = lexical_search.ordered(doc, term, 512, 32)
    order = np.concatenate(leaves)
    assert sorted(order) == list(range(512)) and all(len(x) <= 32 for x in leaves)

    def gaps(place):
        return sum(np.log2(np.diff(np.sort(place[doc[term == t]])) + 1).sum() for t in np.unique(term))

    place = np.empty(512, int)
    place[order] = np.arange(512)
    assert gaps(place) < 0.8 * gaps(np.arange(512))


def test_clusters_are_skipped_only_below_what_counts(spark):
    """Four topics without common words: an item of one reads few clusters."""
    docs = [(k, " ".join(f"t{k % 4}x{x}" for x in RNG.integers(0, 30, 12))) for k in range(2000)]
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = index.clusters.collect()
    item = lexical_search._counted(lexical_search.pa.array(["t1x1 t1x2"]), None)
    _, _, h, tf = next(item)
    asked = lexical_search.Asked(h, tf[None, :].astype(float), np.zeros(1, np.int64))
    hit = [int(lexical_search._bounds(r.asDict(), asked)[0]) for r in rows]
    assert len(rows) >= 16 and sum(x > 0 for x in hit) <= len(rows) / 2


# -- hard negatives


def brute_mine(data, every, shift, positives, k):
    seen = []
    for i, v, label in {(i, None if v is None else tuple(v), label) for i, v, label in data}:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if shift and i is not None and i % shift == 0:
            label = (label + 1) % 10
        seen.append((i, tuple(math.floor(256 * x) for x in v), label, v))
    place = lambda r: (r[0] is None, r[0] or 0)
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    dot = lambda a, b: clip(sum(int(x) * int(y) for x, y in zip(a[1], b[1], strict=True)))
    out = []
    for a in seen:
        if a[0] is None or a[0] % every:
            continue
        others = [(dot(a, b), b) for b in seen if len(b[1]) == len(a[1]) and b is not a]
        good = sorted(((s, b) for s, b in others if b[2] == a[2]), key=lambda x: (-x[0], *place(x[1])))[:positives]
        for s, p in good:
            bad = sorted(((t, b) for t, b in others if b[2] != a[2] and 30 * s <= 100 * t <= 90 * s), key=lambda x: (-x[0], *place(x[1])))[:k]
            out += [(a[0], p[0], r + 1, b[0], s, t) for r, (t, b) in enumerate(bad)]
    return sorted(out, key=str)


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) + rng.normal(size=(8, d))[rng.integers(0, 8, n)]
    v *= rng.choice([0.1, 1.0, 1.0, 5.0], n)[:, None]
    return [(k, [float(np.float32(x)) for x in row], int(rng.integers(0, 10))) for k, row in enumerate(v)]


ODD = [
    (2000, None, 1), (2001, [1.0] * 6, None), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] * 6, 1), (2005, [0.0] * 6, 1), (2010, [], 3), (2020, [], 3), (2011, [], 4),
    (None, [2.0] * 6, 1), (None, [1.5] * 6, 2), (2030, [0.5, 0.5], 1), (2040, [0.5, 0.25], 1), (2031, [0.25, 0.25], 2), (2032, [0.25, 0.25], 2),
    *[(3000 + k, [1.0, 0.5, 0.0, 0.0, 0.25, -0.5], k % 3) for k in range(60)],
]


@pytest.mark.parametrize("bucket,span,block", [(4096, 4, 2048), (16, 2, 5), (7, 1, 1)])
def test_mine_is_brute_force(spark, monkeypatch, bucket, span, block):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "SPAN", span)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    data = vectors(240, 6, bucket) + ODD
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("clash")).withColumn("span", F.lit(1))
    df = df.unionByName(df.where("vec_id % 20 = 0"))  # repeated rows count once
    got = sorted(map(tuple, hard_negatives.mine(df, every=10, k=4).collect()), key=str)
    want = brute_mine(data, 10, 7, 5, 4)
    assert want and got == want


def test_mine_of_large_components_and_no_rows(spark):
    data = [(10, [3e9, 1e9], 1), (11, [2e9, 5e8], 1), (12, [1e9, 1e9], 2), (13, [5e8, 1e9], 2), (20, [1e30, 1e30], 1), (14, [-1e30, 0.0], 2), (15, [1e300, 1e308], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, hard_negatives.mine(df, every=10, shift=None).collect()), key=str)
    assert got == brute_mine([(i, [min(x, 1e300 / 256) for x in v], y) for i, v, y in data], 10, None, 5, 10)
    assert hard_negatives.mine(df.limit(0)).count() == 0


# -- shards


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if fits:
            b = min(fits)[1]
            rooms[b] -= s
        else:
            b = len(rooms)
            rooms.append(max(capacity, s) - s)
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_plain_best_fit(monkeypatch, seed):
    monkeypatch.setattr(sharding.Rooms, "WIDTH", 3)
    rng = np.random.default_rng(seed)
    sizes = sorted(map(int, rng.integers(1, 60, 400)), reverse=True)
    assert sharding.best_fit(sizes, 50) == plain_best_fit(sizes, 50)
    most = max(plain_best_fit(sizes, 50)) + 1
    assert sharding.best_fit(sizes, 50, most) and sharding.best_fit(sizes, 50, most - 1) is None


@pytest.mark.parametrize("sizes,bins", [([5] * 80, 40), ([1000, *[3] * 300], 10), ([9], 4), ([], 3), ([7, 7], 2), ([100, 90, 1, 1], 3), (list(range(200, 0, -1)), 7)])
def test_near_equal(sizes, bins):
    out = sharding.near_equal(sizes, bins)
    load = np.bincount(out, weights=sizes, minlength=bins) if sizes else np.zeros(bins)
    assert len(out) == len(sizes) and len(load) == bins
    fair = [s for s in sizes if s * bins < sum(sizes)]
    if len(fair) == len(sizes) and sizes:
        assert load.max() - load.min() <= sizes[0]


SHARDED = [(k, t) for k, t in enumerate(TEXTS)] + [*[(1000 + k, "a text of very many") for k in range(400)], (None, "a text of very many"), (None, None), (1, None), (2, ""), (2, ""), (3, "é" * 50), (4, "long " * 20_000), (4, "long " * 20_000)]


@pytest.mark.parametrize("rows_of_range,grain", [(1 << 16, 1 << 15), (8, 4)])
def test_shards_hold_groups_and_number_rows(spark, monkeypatch, rows_of_range, grain):
    monkeypatch.setattr(sharding, "RANGE", rows_of_range)
    monkeypatch.setattr(sharding, "GRAIN", grain)
    df = spark.createDataFrame(SHARDED, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(3)
    out = sharding.shards(df, 5).collect()
    own = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted((own(*x) for x in SHARDED), key=str)
    slots, shard_of, load = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert all(len(x) == 1 for x in shard_of.values())
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    two = sorted(load.values())[-2:]  # two groups are larger than an equal share
    rest = sorted(load.values())[:-2]
    assert grain == 4 or (two[-1] == 2 * (100_000 + 16) and rest[-1] - rest[0] <= 0.02 * rest[-1])
    again = sharding.shards(df.repartition(2), 5).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_pack_keeps_to_the_capacity(spark):
    df = spark.createDataFrame(SHARDED, "doc_id long, text string")
    out = sharding.pack(df, 30_000).groupBy("shard").agg(F.sum("size").alias("s"), F.countDistinct("text_crc32").alias("n")).collect()
    total = sum(r["s"] for r in out)
    assert all(r["s"] <= 30_000 or r["n"] == 1 for r in out) and len(out) <= 2 + -(-total // 25_000)
    assert sharding.shards(df.limit(0)).count() == 0 and sharding.pack(df.limit(0), 100).count() == 0


def test_short_buckets_are_skipped(monkeypatch):
    """Of sixteen buckets of falling norms only those that may reach a window are scored."""
    import pandas as pd

    from quillspark.llm import common as c

    rng = np.random.default_rng(6)
    rows, seen = [], []
    for k in range(16):
        x = rng.integers(-30, 31, (50, 8)) // (1 + k)
        keys = np.arange(k * 50, k * 50 + 50)
        rows.append((8, 0, k, float((x * x).sum(1).max()), 50, c.pack(keys), c.pack(keys), ["b"] * 50, [r.astype(np.int16).tobytes() for r in x]))
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in hard_negatives.BUCKETS.split(", ")])
    a = rng.integers(-30, 31, 8).astype(np.int16)
    size = float((a.astype(float) ** 2).sum())
    least = -(1 << 63)
    asked = pd.DataFrame([(8, 0, 9000, 1, 9001, 1, 0, 1 << 62, least, "a", size, a.tobytes())], columns=[x.split()[0] for x in hard_negatives.WINDOWS.split(", ")])
    product = hard_negatives._product
    monkeypatch.setattr(hard_negatives, "_product", lambda *x: (seen.append(1), product(*x))[1])
    found = hard_negatives._look(frame, asked, False, 10)
    every = sorted(((-int(np.frombuffer(x, np.int16).astype(int) @ a.astype(int)), k) for r in rows for k, x in zip(c.unpack(r[5], 50, np.int64)[0].tolist(), r[8], strict=True)))
    assert [(-s, k) for s, k in zip(found["score"], found["key"], strict=True)] == [(s, k) for s, k in every if s <= 0][:10]
    assert len(seen) < 8
