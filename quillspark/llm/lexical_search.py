"""Ranked lexical search over an index whose documents graph bisection reorders.

Index.  The texts are read once: for each document its tokens are counted, and
the hashes of its terms are kept with their frequencies (of the terms that the
queries use, if these are few enough to be sent to all tasks; else of all).
Recursive graph bisection orders the documents: halves of equal size are mended
by exchanging the pairs of documents whose exchange shortens the gaps in the
posting lists.  Its upper levels are fitted on at most ``SAMPLE`` documents; the
tables of their halves lead every document down the tree to a leaf.  The
documents of a leaf are dealt to groups of about ``GROUP``, so also those of a leaf
of very many copies, and one task bisects a group over all its terms, down to
clusters of at most ``LEAF`` documents.  A cluster is a row: its terms, and for each
the number of its documents, its greatest part of a score, and the postings.

Search.  Items are taken in blocks of bounded size.  Document frequencies are
summed over the clusters, whose bounds follow from the greatest parts; each
item reads its ``FIRST`` best clusters, whose ``k``-th score is the least that
counts.  All other clusters are visited in the order of their bounds, and only
where the bound reaches the ``k``-th score found so far: what is skipped cannot
be among the ``k`` best, equal scores included, which go by ``doc_id`` and not
by place in the index.  Scores are whole numbers, summed exactly.

Rows: a null or empty text has no terms, is no document of N and is never found;
an item without terms finds nothing; a repeated document is a document each
time; a document without an id comes after others of its score; items are
known by id and text, and a repeated item counts once; further columns are not
read, whatever they are called; empty tables give an empty result.  Terms are
equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import common as c

SAMPLE = 1 << 14  # documents on which the upper levels are fitted
EDGES = 256  # terms of such a document: those of the least hashes
SLOTS = 1 << 14  # terms of the tables that lead documents down
GROUP = 1 << 14  # documents that a task bisects, about,
WIDE = 1 << 22  # and their terms
LEAF = 128  # documents of a cluster (at most 256)
TURNS = 4  # exchanges at each level
WORDS = 1 << 20  # terms of all items up to which others are not sent
BLOCK = 512  # items of a block, about,
ASKED = 1 << 17  # and their terms
FIRST = 4  # clusters that an item reads first

POSTINGS = "key long, n long, m int, terms binary"
CLUSTER = "part int, cluster long, n_terms int, n_docs int, n_post long, terms binary, df binary, most binary, keys binary, docs binary, impact binary"


# -- documents and their terms -------------------------------------------------


def _counted(texts: pa.Array, only: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each text (place, tokens, hashes of terms in order, frequencies)."""
    for i, _, data, at in c.slices(texts):
        t = c.tokens(data, at, c.folded())
        for k in range(len(at) - 1):
            h = t.hashes[t.first[k] : t.first[k + 1]]
            term, tf = np.unique(h, return_counts=True)
            if only is not None and len(term):
                kept = only[np.minimum(np.searchsorted(only, term), len(only) - 1)] == term if len(only) else np.zeros(len(term), bool)
                term, tf = term[kept], tf[kept]
            yield i + k, len(h), term, tf.astype(np.int32)


def documents(df: DataFrame, doc_id: str, text: str, only: np.ndarray | None) -> DataFrame:
    """(key, n, m, terms) of the documents that have a token: their number, and
    their ``m`` terms packed with their frequencies."""
    held = df.sparkSession.sparkContext.broadcast(only)  # at most WORDS hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, len(h), c.pack(h, tf)) for k, n, h, tf in _counted(b.column("text"), held.value) if n]
            keys = b.column("key").take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.record_batch([keys, *[pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(kinds)]], names=["key", "n", "m", "terms"])

    src = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(c.NO_ID)).alias("key"), F.col(text).cast("string").alias("text"))
    return src.where("text is not null").mapInArrow(run, POSTINGS)


def items(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, tie, m, terms) of the items that have a term, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, len(h), c.pack(h, tf)) for k, n, h, tf in _counted(b.column("text"), None) if n]
            own = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([b.column("item_id").take(own), b.column("tie").take(own), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["item_id", "tie", "m", "terms"])

    src = df.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(text).cast("string")).alias("tie"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = src.schema["item_id"].dataType.simpleString()
    return src.dropDuplicates(["item_id", "tie"]).mapInArrow(run, f"item_id {kind}, tie long, m int, terms binary")


# -- bisection -------------------------------------------------------------------


def _gap(part: np.ndarray, whole: int) -> np.ndarray:
    return part * np.log2(whole / (part + 1.0))


def halves(doc: np.ndarray, term: np.ndarray, n: int, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``n`` documents go right, given the edges (doc, term) in the
    order of documents, and the degrees of terms left and right."""
    right = np.arange(n) >= (n + 1) // 2
    most = int(term.max()) + 1 if len(term) else 1
    first = np.searchsorted(doc, np.arange(n + 1))
    some = first[:-1] < first[1:]
    sizes = n - int(right.sum()), int(right.sum())
    for _ in range(turns):
        side = right[doc]
        l, r = np.bincount(term[~side], minlength=most), np.bincount(term[side], minlength=most)
        now = _gap(l, sizes[0]) + _gap(r, sizes[1])
        go = now - _gap(np.maximum(l - 1, 0), sizes[0]) - _gap(r + 1, sizes[1])
        come = now - _gap(l + 1, sizes[0]) - _gap(np.maximum(r - 1, 0), sizes[1])
        each = np.where(side, come[term], go[term])
        gain = np.zeros(n)
        if len(each):
            gain[some] = np.add.reduceat(each, first[:-1][some])
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        swap = int((gain[a[:k]] + gain[b[:k]] > 1e-9).sum())  # both fall, so these come first
        if not swap:
            break
        right[a[:swap]], right[b[:swap]] = True, False
    side = right[doc]
    return right, np.bincount(term[~side], minlength=most), np.bincount(term[side], minlength=most)


def _edges(doc: np.ndarray, term: np.ndarray, mine: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the documents ``mine``, numbered anew in their order; terms of
    one document only tell nothing and go."""
    place = np.full(n, -1)
    place[mine] = np.arange(len(mine))
    at = place[doc]
    at, t = at[at >= 0], term[at >= 0]
    t = np.unique(t, return_inverse=True)[1].reshape(-1)
    held = np.bincount(t)[t] > 1 if len(t) else np.zeros(0, bool)
    order = np.argsort(at[held], kind="stable")
    return at[held][order], t[held][order]


def ordered(doc: np.ndarray, term: np.ndarray, n: int, leaf: int) -> list[np.ndarray]:
    """The documents by leaves of at most ``leaf``, in the order of the bisection."""
    out, todo = [], [(np.arange(n), *_edges(doc, term, np.arange(n), n))]
    while todo:
        mine, d, t = todo.pop()
        if len(mine) <= leaf:
            out.append(mine)
            continue
        right = halves(d, t, len(mine))[0]
        for some in (np.flatnonzero(right), np.flatnonzero(~right)):  # the left one is next
            todo.append((mine[some], *_edges(d, t, some, len(mine))))
    return out


class Tree(NamedTuple):
    """For each inner node what each slot speaks for (above 0: right), and the
    value from which documents go right; node k has the children 2k+1, 2k+2."""

    weights: np.ndarray  # (nodes, SLOTS) float32
    middle: np.ndarray  # (nodes,) float64
    depth: int


def grow(rows: list[np.ndarray], leaf: int = LEAF) -> Tree:
    """The upper levels, fitted on the slots of some documents."""
    depth = max(0, int(np.floor(np.log2(max(1, len(rows)) / leaf))))
    weights, middle = np.zeros(((1 << depth) - 1, SLOTS), np.float32), np.full((1 << depth) - 1, np.inf)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    todo = [(0, np.arange(len(rows)))] if depth else []
    while todo:
        node, mine = todo.pop()
        if len(mine) < 2:  # the rest of the branch stays empty: all go left
            continue
        place = np.full(len(rows), -1)
        place[mine] = np.arange(len(mine))
        held = place[doc] >= 0
        d, s = place[doc[held]], slot[held]
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
        right, l, r = halves(d, s, len(mine))
        w = np.zeros(SLOTS)
        w[: len(l)] = np.log2((r + 1) / max(1, right.sum())) - np.log2((l + 1) / max(1, (~right).sum()))
        weights[node] = w
        score = np.bincount(d, weights=weights[node][s].astype(np.float64), minlength=len(mine))
        middle[node] = np.median(score)
        goes = score > middle[node]
        if 2 * node + 1 < len(weights):
            todo += [(2 * node + 1, mine[~goes]), (2 * node + 2, mine[goes])]
    return Tree(weights, middle, depth)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> c.U(50)).astype(np.int64)


def leaf_of(tree: Tree, sizes: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The leaf of each document, given how many terms each has and their slots."""
    node = np.zeros(len(sizes), np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(tree.depth):
        score = np.bincount(own, weights=tree.weights[node[own], slot].astype(np.float64), minlength=len(sizes))
        node = 2 * node + 1 + (score > tree.middle[node])
    return node - ((1 << tree.depth) - 1)


# -- index -----------------------------------------------------------------------


class Index(NamedTuple):
    clusters: DataFrame  # one row for each cluster
    documents: int  # that have a term
    tokens: int


def _impact(tf: np.ndarray, n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    m = 25 + 75 * n.astype(np.int64) * documents // tokens
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build(df: DataFrame, doc_id: str = "doc_id", text: str = "text", only: np.ndarray | None = None) -> Index:
    """The clustered index of all documents, for the terms of the sorted hashes
    ``only``, or for all."""
    spark = df.sparkSession
    docs = c.cut(documents(df, doc_id, text, only).withColumn("seq", F.monotonically_increasing_id()), "terms")
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    n_docs, n_tokens = total["n"], total["t"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [c.unpack(x, m, np.uint64, np.int32)[0][:EDGES] for x, m in zip(b.column("terms").to_pylist(), b.column("m").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("seq"), pa.array([np.unique(slots(h)).astype(np.uint16).tobytes() for h in rows], pa.binary())], names=["seq", "slots"])

    few = docs.where("m > 0").select("seq", "m", "terms").orderBy(F.xxhash64("seq"), "seq").limit(SAMPLE).mapInArrow(sketch, "seq long, slots binary")
    tree = grow([np.frombuffer(r, np.uint16) for r in few.toArrow().sort_by("seq")["slots"].to_pylist()])
    held = spark.sparkContext.broadcast(tree)  # SAMPLE / LEAF tables of SLOTS numbers at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.asarray(b.column("m"))
            terms = [c.unpack(x, k, np.uint64, np.int32)[0] for x, k in zip(b.column("terms").to_pylist(), m.tolist(), strict=True)]
            leaf = np.zeros(len(m), np.int64)
            step = 256  # documents whose slots are held at once
            for s in range(0, len(m), step):
                leaf[s : s + step] = leaf_of(held.value, m[s : s + step], slots(np.concatenate([np.zeros(0, c.U), *terms[s : s + step]])))
            yield pa.record_batch([b.column("seq"), b.column("key"), b.column("n"), b.column("m"), b.column("terms"), pa.array(leaf.astype(np.int32))], names=["seq", "key", "n", "m", "terms", "leaf"])

    placed = docs.select("seq", "key", "n", "m", "terms").mapInArrow(place, "seq long, key long, n long, m int, terms binary, leaf int")
    counts = placed.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("m").alias("wide"))
    parts = counts.select("leaf", F.greatest(F.ceil(F.col("docs") / GROUP), F.ceil(F.col("wide") / WIDE), F.lit(1)).alias("parts")).collect()  # a number for each leaf
    first = np.concatenate([[0], np.cumsum([r["parts"] for r in parts])]).astype(int)
    table = spark.createDataFrame([(r["leaf"], int(f), int(r["parts"])) for r, f in zip(parts, first, strict=False)], "leaf int, first int, parts int")
    dealt = placed.join(F.broadcast(table), "leaf").select("key", "n", "m", "terms", "seq", (F.col("first") + F.pmod(F.xxhash64("seq"), "parts")).cast("int").alias("part"))

    def bisect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        m = pdf["m"].to_numpy()
        h, tf = c.unpack_all(pdf["terms"], m, np.uint64, np.int32)
        doc = np.repeat(np.arange(len(pdf)), m)
        impact = _impact(tf, np.repeat(pdf["n"].to_numpy(), m), n_docs, n_tokens)
        key, at = pdf["key"].to_numpy(), np.append(0, np.cumsum(m))
        term = np.unique(h, return_inverse=True)[1].reshape(-1)
        rows = []
        part = int(pdf["part"].iloc[0])
        for k, mine in enumerate(ordered(doc, term, len(pdf), LEAF)):
            spot = np.concatenate([np.arange(at[i], at[i + 1]) for i in mine]) if len(mine) else np.zeros(0, int)
            local = np.repeat(np.arange(len(mine)), m[mine])
            order = np.lexsort((local, h[spot]))
            spot, local = spot[order], local[order]
            terms, start, df = np.unique(h[spot], return_index=True, return_counts=True)
            most = np.maximum.reduceat(impact[spot], start) if len(start) else np.zeros(0, np.int64)
            rows.append((part, (part << 32) + k, len(terms), len(mine), len(spot), c.pack(terms), c.pack(df.astype(np.int32)), c.pack(most.astype(np.int32)), c.pack(key[mine]), c.pack(local.astype(np.uint8)), c.pack(impact[spot].astype(np.int32))))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in CLUSTER.split(", ")])

    tasks = max(c.partitions(spark), 1)
    clusters = dealt.repartition(tasks, "part").groupBy("part").applyInPandas(bisect, CLUSTER)
    return Index(c.cut(clusters, "clusters"), n_docs, n_tokens)


# -- search ------------------------------------------------------------------------


class Asked(NamedTuple):
    """A block of items: their terms, how often each item has each, and the weights."""

    terms: np.ndarray  # sorted hashes
    often: np.ndarray  # (items, terms) float64
    least: np.ndarray  # (items,) scores that still count


def _found(terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common hashes in both sorted arrays."""
    if not len(terms) or not len(asked):
        return np.zeros(0, int), np.zeros(0, int)
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == asked)
    return at[hit], hit


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of whole numbers held as doubles, exactly, in 64 bits."""
    out = a @ b
    if out.size and out.max() >= 1 << 52:  # doubles might round
        return a.astype(np.int64) @ b.astype(np.int64)
    return out.astype(np.int64)


def _bounds(row: dict, asked: Asked) -> np.ndarray:
    """What no document of a cluster exceeds, for each item."""
    at, hit = _found(c.unpack(row["terms"], row["n_terms"], np.uint64)[0], asked.terms)
    most = c.unpack(row["most"], row["n_terms"], np.int32)[0][at]
    return _times(asked.often[:, hit], most.astype(np.float64)[:, None])[:, 0]


def _scores(row: dict, asked: Asked, who: np.ndarray) -> np.ndarray:
    """(items, documents) of a cluster."""
    at, hit = _found(c.unpack(row["terms"], row["n_terms"], np.uint64)[0], asked.terms)
    df = c.unpack(row["df"], row["n_terms"], np.int32)[0]
    start = np.cumsum(df) - df
    doc, impact = c.unpack(row["docs"], row["n_post"], np.uint8)[0], c.unpack(row["impact"], row["n_post"], np.int32)[0]
    of = np.repeat(np.arange(len(at)), df[at])
    spot = np.repeat(start[at] - (np.cumsum(df[at]) - df[at]), df[at]) + np.arange(len(of))
    part = np.zeros((len(at), row["n_docs"]))
    part[of, doc[spot]] = impact[spot]
    return _times(asked.often[np.ix_(who, hit)], part)


def _top(score: np.ndarray, keys: np.ndarray, least: int, k: int) -> np.ndarray:
    """Documents of the ``k`` best scores above 0 that reach ``least``."""
    some = np.flatnonzero((score > 0) & (score >= least))
    return some[np.lexsort((keys[some], -score[some]))[:k]]


FOUND = "item int, key long, score long"


def _visits(clusters: DataFrame, held, k: int, chosen=None) -> DataFrame:
    """(item, key, score) of documents that may be among the ``k`` best.  With
    ``chosen`` (cluster, its items) only these are read; without it clusters are
    visited by their bounds, and skipped where the bound is below what counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value[0]
        done = held.value[1]
        best = [np.zeros(0, np.int64)] * len(asked.least)
        least = asked.least.copy()
        for b in batches:
            rows = b.to_pylist()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            bounds = np.stack([_bounds(r, asked) for r in rows]) if rows else np.zeros((0, len(least)), np.int64)
            for i in np.argsort(-bounds.max(1, initial=0), kind="stable"):
                row = rows[i]
                first = done.get(row["cluster"], np.zeros(0, int))
                if chosen:
                    who = first
                else:
                    who = np.setdiff1d(np.flatnonzero((bounds[i] >= least) & (bounds[i] > 0)), first)
                if not len(who):
                    continue
                keys = c.unpack(row["keys"], row["n_docs"], np.int64)[0]
                score = _scores(row, asked, who)
                for j in np.flatnonzero(score.max(1, initial=0) >= np.maximum(least[who], 1)):
                    q = who[j]
                    top = _top(score[j], keys, least[q], k)
                    out.append((np.full(len(top), q, np.int32), keys[top], score[j][top]))
                    best[q] = -np.sort(-np.append(best[q], score[j][top]))[:k]
                    if len(best[q]) == k:
                        least[q] = max(least[q], best[q][-1])
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            yield pa.record_batch([pa.array(x) for x in cols], names=["item", "key", "score"])

    return clusters.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(spark: SparkSession, index: Index, block: pa.Table, k: int) -> DataFrame | None:
    """The rows of one block of items."""
    m = np.asarray(block["m"])
    h, often = c.unpack_all(block["terms"].to_pylist(), m, np.uint64, np.int32)
    terms, at = np.unique(h, return_inverse=True)
    count = np.zeros((len(m), len(terms)))
    count[np.repeat(np.arange(len(m)), m), at.reshape(-1)] = often
    sent = spark.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for t, d, n in zip(b.column("terms").to_pylist(), b.column("df").to_pylist(), b.column("n_terms").to_pylist(), strict=True):
                x, y = _found(c.unpack(t, n, np.uint64)[0], sent.value)
                df[y] += c.unpack(d, n, np.int32)[0][x]
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    df = np.zeros(len(terms), np.int64)
    for r in index.clusters.select("n_terms", "terms", "df").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the terms of a block
        df[r["term"]] = r["df"]
    weight = np.floor(1000 * np.log((2.0 * index.documents + 2) / (2.0 * df + 1)))
    asked = Asked(terms, count * weight, np.zeros(len(m), np.int64))
    held = spark.sparkContext.broadcast((asked, {}))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [[] for _ in range(len(m))]
        for b in batches:
            for row in b.to_pylist():
                x = _bounds(row, held.value[0])
                for q in np.flatnonzero(x):
                    near[q].append((int(x[q]), row["cluster"]))
            near = [sorted(x, reverse=True)[:FIRST] for x in near]
        rows = [(q, y, x) for q, some in enumerate(near) for x, y in some]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["item", "key", "score"])

    first = _best(index.clusters.select("cluster", "n_terms", "terms", "most").mapInArrow(bounds, FOUND), FIRST)
    chosen: dict[int, list[int]] = {}
    for r in first.select("item", "key").collect():  # FIRST for each item of the block
        chosen.setdefault(r["key"], []).append(r["item"])
    if not chosen:
        return None
    done = {x: np.array(sorted(y)) for x, y in chosen.items()}
    ids = spark.createDataFrame([(int(x),) for x in done], "cluster long")
    held = spark.sparkContext.broadcast((asked, done))
    head = c.cut(_best(_visits(index.clusters.join(F.broadcast(ids), "cluster", "left_semi"), held, k, chosen=True), k), "first")
    least = asked.least
    for r in head.where(F.col("rank") == k).select("item", "score").collect():  # a number for each item
        least[r["item"]] = r["score"]
    rest = _visits(index.clusters, spark.sparkContext.broadcast((asked._replace(least=least), done)), k)
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(m), dtype=np.int32)), "item_id": block["item_id"], "tie": block["tie"]}))
    return _best(head.drop("rank").unionByName(rest), k).join(F.broadcast(names), "item").select("item_id", "rank", "key", "score")


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item (see
    :func:`items`), by score, then id."""
    spark = asked.sparkSession
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-size["m"] // ASKED))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "tie"), F.lit(blocks)))
    kind = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks if index.documents else 0):
        block = dealt.where(F.col("block") == b).drop("block").toArrow()
        if block.num_rows:
            found = _block(spark, index, block.sort_by([("item_id", "ascending"), ("tie", "ascending")]), k)
            if found is not None:
                out = out.unionByName(found.select("item_id", "rank", F.nullif("key", F.lit(c.NO_ID)).alias("doc_id"), "score"))
    return out


def vocabulary(asked: DataFrame) -> np.ndarray | None:
    """Sorted hashes of the terms of all items; none if there are over ``WORDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = c.unpack_all(b.column("terms").to_pylist(), b.column("m").to_pylist(), np.uint64, np.int32)[0]
            yield pa.record_batch([pa.array(np.unique(h).view(np.int64))], names=["h"])

    found = asked.select("m", "terms").mapInArrow(run, "h long").distinct().limit(WORDS + 1).toArrow()
    return None if found.num_rows > WORDS else np.sort(np.asarray(found["h"]).view(np.uint64))


def rank(df: DataFrame, queries: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """The ``k`` best documents of ``df`` for each item of ``queries``."""
    asked = c.cut(items(queries, item_id, text), "items")
    return search(build(df, doc_id, text, vocabulary(asked)), asked, k)


#: DuckDB's rows for :func:`rank` over ``documents`` and ``benchmark``.
SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT item_id, md5(text) AS tie, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, tie, term, count(*)::BIGINT AS often FROM i GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * max(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
r AS (
  SELECT item_id, tie, row, doc_id, sum(often * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (row), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id, tie ORDER BY score DESC, doc_id, row)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""
