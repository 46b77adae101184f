"""The text operators against brute force, and on awkward rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, decontamination, mixing, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{(k * 7919) % 977}" for k in range(400)]
LONG = " ".join(WORDS[:120])


def rows(*texts):
    return [(i, t, "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]


AWKWARD = rows(
    None, "", "  \t\n ", "one", "two words", LONG, LONG, LONG + " tail", " ".join(WORDS[60:200]),
    "x " * 3000, " ".join(WORDS[:40]) + " nb sp", "é " * 30 + "ß", " ".join(WORDS * 20), LONG.replace("w0", "other"),
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


A, B = "abcdefgh" * 8, "zyxwvuts" * 8  # tokens of several blocks of 64 bytes
BLOCKS = [A + B + B + A, B + A + A + B, A + A, B + B, A + B, B + A, A, B, A + "x", "x" + A]
#: Null ids, ids with several texts, repeated rows, and words whose blocks are alike.
CLASHING = AWKWARD + [
    (None, LONG, "en", "s", 0), (None, " ".join(WORDS[200:260]), "en", "s", 0), (None, " ".join(WORDS[210:270]), "en", None, 0), (None, None, "en", "s", 0), (None, "", "en", "s", 0),
    (5, " ".join(WORDS[205:250]), "en", "s", 0), (5, LONG, "en", "s", 0), (7, None, "en", "s", 0), (70, " ".join(BLOCKS * 3), "en", "s", 0), (71, " ".join([*BLOCKS[1:], BLOCKS[0]] * 3), "en", "s", 0),
]


def test_tokens_of_long_words_and_texts():
    texts = [" ".join(BLOCKS), "", "a" * 64, "a" * 65, " x" * 40_000, "é" * 5000, *BLOCKS]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(x.encode()) for x in texts]))
    words = [plain_words(x) for x in texts]
    whole = common.tokens(data, at, common.spaced())
    assert list(np.diff(whole.first)) == list(map(len, words))
    assert len(set(whole.hashes.tolist())) == len({w for x in words for w in x})
    for most in (1, 50, 1000):
        assert all((x == y).all() for x, y in zip(whole, common.tokens(data, at, common.spaced(), most), strict=True))


def ordered(row):
    """The place of a row: its id, nulls last, then the hash of its text."""
    return (row[0] is None, row[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((row[1] or "").encode(), 42))))


def brute_dedup(data, window):
    """By (id, text); rows equal in both are one."""
    seen, out = set(), {}
    for i, text in sorted({x[:2] for x in data}, key=ordered):
        w = plain_words(text)
        off = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                off[k : k + window] = [True] * window
            seen.add(key)
        kept = " ".join(a for a, o in zip(w, off, strict=True) if not o)
        out[i, text] = (len(w), sum(off), hashlib.sha256(kept.encode()).hexdigest())
    return out


def as_rows(found, data):
    return sorted(((x[0], *found[x[:2]]) for x in data), key=str)


@pytest.mark.parametrize("window,room", [(1, 1 << 19), (2, 1 << 19), (7, 64), (20, 1 << 19), (20, 1), (20, 64), (20, 400)])
def test_substring_dedup_is_brute_force(spark, window, room):
    docs = spark.createDataFrame(CLASHING, SCHEMA).withColumn("key", F.lit("clash")).withColumn("starts", F.lit("clash"))
    got = sorted(map(tuple, substring_dedup.digests(docs, window=window, room=room).collect()), key=str)
    assert got == as_rows(brute_dedup(CLASHING, window), CLASHING)


def test_substring_dedup_of_repeated_and_no_rows(docs):
    twice = substring_dedup.substring_dedup(docs.unionByName(docs))
    want = [(x[0], *found[:2]) for x, found in zip(AWKWARD, map(brute_dedup(AWKWARD, 20).get, [x[:2] for x in AWKWARD]), strict=True)]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in twice.collect()) == sorted(2 * want)
    assert substring_dedup.digests(docs.limit(0)).count() == 0 and substring_dedup.strip_documents(docs.limit(0)).count() == 0


def test_suffix_array_gives_shared_words():
    rng = np.random.default_rng(4)
    word = rng.integers(0, 3, 300).astype(np.uint64)
    first = np.array([0, 90, 120, 300])
    for window in (1, 2, 5, 20):
        at = np.concatenate([np.arange(s, e - window + 1) for s, e in zip(first[:-1], first[1:], strict=True)])
        end = first[np.searchsorted(first, at, "right")]
        rank, shared = substring_dedup.suffix_array(word, at, end, window)
        order = np.argsort(rank, kind="stable")
        cut = [tuple(word[k : k + window]) for k in at[order]]
        assert cut == sorted(cut)
        for a, b, n in zip(order[:-1], order[1:], shared(order[:-1], order[1:]), strict=True):
            both = 0
            while both < min(end[a] - at[a], end[b] - at[b], (2 << int(np.log2(window))) - 1) and word[at[a] + both] == word[at[b] + both]:
                both += 1
            assert n == both


def test_strip_documents_keeps_columns_and_untouched_rows(docs):
    clash = docs.withColumns({x: F.lit("clash") for x in ("_id", "_text", "_all", "rest", "key", "a.b", "part")})
    out = substring_dedup.strip_documents(clash)
    assert out.columns == clash.columns and {r["_text"] for r in out.collect()} == {r["a.b"] for r in out.collect()} == {"clash"}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] is None and got[2] == "  \t\n " and got[5] == LONG and 6 not in got and got[7] == "tail"


def brute_classes(data, n=5, threshold=0.8):
    """Class id and links of each row, by its number."""
    sets = []
    for _, text, *_ in data:
        w = plain_words(text)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    links, root = [0] * len(data), list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a + 1, len(data)):
            if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    own = [find(k) for k in range(len(data))]
    least = {r: min((data[k][0] for k in range(len(data)) if own[k] == r and data[k][0] is not None), default=None) for r in own}
    return [(data[k][0], least[own[k]], links[k]) for k in range(len(data))], own


NEAR = [(100 + k, " ".join(WORDS[k : k + 200]), "en", "s", 0) for k in range(9)] + [(None, " ".join(WORDS[4:205]), "en", "s", 0), (102, " ".join(WORDS[1:203]), "en", "s", 0), (None, " ".join([*BLOCKS, "x"]), "en", "s", 0), (None, " ".join([*BLOCKS[1:], "x"]), "en", "s", 0)]


@pytest.mark.parametrize("block", [2, 512])
def test_ngram_join_is_brute_force(spark, block):
    data = CLASHING + NEAR
    docs = spark.createDataFrame(data, SCHEMA).withColumn("key", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = sorted(map(tuple, ngram_join.similar(docs, block=block).collect()), key=str)
    assert got == sorted(brute_classes(data)[0], key=str)


def test_ngram_join_edges(spark, docs):
    assert ngram_join.similar(docs.limit(0)).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0
    assert ngram_join.similar(docs.unionByName(docs)).count() == 2 * len(AWKWARD)


def test_one_row_of_each_class_stays(spark):
    data = CLASHING + NEAR + AWKWARD[:9]
    clash = spark.createDataFrame(data, SCHEMA).withColumns({x: F.lit("clash") for x in ("key", "a.b", "rest", "gone")})
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns
    groups = defaultdict(list)
    for x, own in zip(data, brute_classes(data)[1], strict=True):
        groups[own if plain_words(x[1]) else ordered(x) + (len(groups),)].append(x)
    want = [min(v, key=ordered)[:2] for v in groups.values()]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_least_matches_drop_less_than_tolerance():
    need = ngram_join.least_matches(0.8, 1e-6)
    assert len(need) == 8 and list(need) == sorted(need) and 0 < need[0] < 13 and need[-1] < 0.8 * 128


ITEMS = [
    (1, " ".join(WORDS[10:40])), (2, "W5 one"), (3, None), (4, ""), (5, "ONE"), (6, " ".join(WORDS[10:40])), (17, "É É é"), (18, " ".join(WORDS[300:310]).upper()), (None, " ".join(WORDS[200:230])), (None, "two"),
    (7, " ".join([A + B + B + A, "y"])), (7, "x " * 200), (8, "one two three one two three one two three one two three"),
]


def fold(text):
    lowered = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_overlap(data, items):
    out = {}
    for i, text in {x[:2] for x in data}:
        w, hit, met = fold(text), set(), set()
        for item, t in items:
            b = fold(t)
            k = min(10, len(b))
            runs = {tuple(b[s : s + k]) for s in range(len(b) - k + 1)} if k else set()
            for s in range(len(w) - k + 1):
                if k and tuple(w[s : s + k]) in runs:
                    hit |= set(range(s, s + k))
                    met.add(item)
        names = ",".join(sorted(str(x) for x in met if x is not None))
        out[i, text] = (len(w), len(hit), len(met), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_decontamination_is_brute_force(spark, most):
    more = [(50, "é É É é ONE-two", "fr", None, 0), (51, "one." + " ".join(WORDS[295:315]), "en", "s", 0), (52, B + A + A + B + " y", "en", "s", 0), (53, "one two three " * 2000 + "x " * 30_000, "en", "s", 0)]
    data = CLASHING + more
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("clash"))
    docs = spark.createDataFrame(data, SCHEMA).withColumn("key", F.lit("clash")).withColumn("item_id", F.lit("clash"))
    got = sorted(map(tuple, decontamination.report(docs, bench, broadcast_rows=most).collect()), key=str)
    assert got == as_rows(brute_overlap(data, ITEMS), data)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_decontamination_edges(spark, docs, most):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.report(docs.limit(0), bench, broadcast_rows=most).count() == 0
    assert not decontamination.report(docs, bench.limit(0), broadcast_rows=most - 1).where("contaminated").count()
    clash = spark.createDataFrame(CLASHING, SCHEMA).withColumns({x: F.lit("clash") for x in ("key", "tie", "a.b", "rest")})
    clean = decontamination.decontaminate(clash, bench, broadcast_rows=most)
    assert clean.columns == clash.columns
    hit = {k for k, v in brute_overlap(CLASHING, ITEMS).items() if v[4]}
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((x[:2] for x in CLASHING if x[:2] not in hit), key=str)


def test_mixing_meets_targets(spark, docs):
    out = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(plain_words(dict((x[0], x[1]) for x in AWKWARD)[r["doc_id"]]))
    total = sum(r["size"] for r in out)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1
    for v in by.values():
        assert sum(r["taken"] for r in v) == int(v[0]["target"]) and v[0]["target"] <= 2 * v[0]["source_size"]
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null")).collect()[0]["taken"] == 0


def test_mixing_of_null_and_repeated_ids(spark):
    data = CLASHING + [(90, "w " * 200_000, "en", "t", 0), (90, "w x", "en", "t", 0)]
    docs = spark.createDataFrame(data, SCHEMA).withColumns({x: F.lit("clash") for x in ("size", "key", "bin", "target")})
    out = mixing.mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(x[0]), len(plain_words(x[1]))) for x in data)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    assert all(sum(r["taken"] for r in v) == int(v[0]["target"]) for v in by.values())
    again = mixing.mix(docs.orderBy(F.rand(3)).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 5, None: 800, "f": 3000}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, live = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if share[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        live -= over
    assert got == pytest.approx(target | share)
