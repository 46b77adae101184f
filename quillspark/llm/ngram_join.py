"""Jaccard similarity join of word n-grams with Bayesian candidate pruning.

Every text is the set of its five-word shingles (a shorter text: one shingle
of all its words).  Texts with equal sets are one class, and one point of the
join.  Points get ``BANDS * ROWS`` MinHash values; those equal in a whole
band become candidates.  A candidate pair is compared value by value in steps
of 16: with a uniform prior on the similarity s, m agreements of n leave the
posterior Beta(m + 1, n - m + 1), and the pair is dropped once
P(s >= threshold) < ``tolerance``.  The pairs that are left connect points to
provisional groups, and are verified there on the shingle sets, so the links
reported are exact.

With 32 bands of 4 values a pair at 0.8 misses every band with probability
5e-8, and pruning drops it with about ``tolerance``.

No pair is ever a row.  Tasks take a bucket (or a group), cut into blocks of
``BLOCK`` members, and two blocks at a time: they return a spanning forest of
the links and the number of links of each member, so a group of thousands of
near copies costs a few rows for each member and tasks of bounded size.  A
member of a group of m is sent once for each of the m / ``BLOCK`` blocks, the
least that an exact count of links takes.

Rows: null and empty texts (no words) are linked to nothing, each a class of
its own; rows without an id, rows of one id, and repeated rows are rows of
their own and linked as their texts are; a class without any id has a null
class_id; equal similarities at the threshold link; further columns are not
read, whatever they are called, and :func:`keep_one` returns them; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common as c

BANDS, ROWS, STEP, BLOCK = 32, 4, 16, 512
_N = BANDS * ROWS
_MUL = (c.mix(np.arange(1, _N + 1, dtype=c.U)) >> c.U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (c.mix(np.arange(1001, _N + 1001, dtype=c.U)) >> c.U(32)).astype(np.uint32)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, sorted distinct shingles of each
    text one after another, and where each text's begin."""
    letters = c.spaced()
    for i, j, data, at in c.slices(batch.column("text")):
        t = c.tokens(data, at, letters)
        of, size = t.text_of(), np.diff(t.first)
        g = c.grams(t.hashes, n)
        ok = np.flatnonzero(t.whole(n, of))
        text, h = of[ok], g[ok]
        for k in range(1, n):  # texts of fewer words
            short = np.flatnonzero(size == k)
            if len(short):
                text = np.append(text, short)
                h = np.append(h, c.grams(t.hashes, k)[t.first[short]])
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        text, h = text[new], h[new]
        yield i, h, np.searchsorted(text, np.arange(j - i + 1))


def signatures(docs: DataFrame, n: int = 5) -> DataFrame:
    """(id, key, tie, digest, sig) of each text: digest of its set of shingles
    and the MinHash values of it, 16 bits each; null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests: list[bytes | None] = [None] * b.num_rows
            sigs: list[bytes | None] = [None] * b.num_rows
            for i, h, first in _sets(b, n):
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                low = (h >> c.U(32)).astype(np.uint32)
                sig = np.empty((len(full), _N), np.uint32)
                for k in range(_N):
                    sig[:, k] = np.minimum.reduceat(low * _MUL[k] + _ADD[k], first[full])
                sig = (sig ^ (sig >> np.uint32(16))).astype(np.uint16)
                for k, x in zip(full.tolist(), sig, strict=True):
                    digests[i + k] = hashlib.blake2b(h[first[k] : first[k + 1]].tobytes(), digest_size=16).digest()
                    sigs[i + k] = x.tobytes()
            yield pa.record_batch([*(b.column(x) for x in ("id", "key", "tie")), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "key", "tie", "digest", "sig"])
        c.trim()

    return docs.mapInArrow(sign, "id long, key long, tie long, digest binary, sig binary")


def _bands(sig: np.ndarray) -> np.ndarray:
    return c.mix(np.ascontiguousarray(sig).view(c.U) + np.arange(BANDS, dtype=c.U) * c.U(0x9E3779B97F4A7C15))


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each n = STEP, 2 * STEP, ...: the fewest agreements with which the
    posterior probability of s >= threshold is at least ``tolerance``."""

    def above(m: int, n: int) -> float:  # P(Beta(m + 1, n - m + 1) >= threshold) = P(Binomial(n + 1, threshold) <= m)
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return tuple(next(m for m in range(n + 1) if above(m, n) >= tolerance) for n in range(STEP, _N + 1, STEP))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of the component of each of ``n`` points under pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        rest = root[a] != root[b]
        a, b = a[rest], b[rest]
    return root


def _pairs(cuts: np.ndarray, right: np.ndarray, two: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same part, in runs of about ``most``.  ``right``:
    rows of the second block, ``two``: parts in which two blocks meet."""
    size = np.diff(cuts)
    for m in np.unique(size[~two]):
        if m < 2:
            continue
        heads = cuts[:-1][(size == m) & ~two]
        if m <= 64:
            x, y = np.triu_indices(m, 1)
            step = max(1, most // len(x))
            for k in range(0, len(heads), step):
                at = heads[k : k + step, None]
                yield (at + x).ravel(), (at + y).ravel()
            continue
        for head in heads:
            for k in range(0, m, max(1, most // m)):
                a, b = np.meshgrid(np.arange(k, min(m, k + max(1, most // m))), np.arange(m), indexing="ij")
                up = a < b
                yield head + a[up], head + b[up]
    for k in np.flatnonzero(two):
        at = np.arange(cuts[k], cuts[k + 1])
        a, b = np.meshgrid(at[~right[at]], at[right[at]], indexing="ij")
        yield a.ravel(), b.ravel()


def _blocked(members: DataFrame, group: str, size: str, block: int = BLOCK) -> DataFrame:
    """``members`` of groups, with ``part``: a group of one block goes to one
    part; of larger groups every two blocks meet in a part of their own."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.when(F.col(size) <= block, F.lit(0)).otherwise(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    out = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).withColumn("part", F.xxhash64(group, "lo", "hi"))


def _deal(df: DataFrame, groups: int) -> DataFrame:
    return df.withColumn("task", F.pmod("part", F.lit(groups)).cast("int"))


def _parts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows sorted by part and key, a repeated row once, and where parts begin
    (one more entry than parts)."""
    pdf = pdf.drop_duplicates(["part", "key"]).sort_values(["part", "key"], kind="stable").reset_index(drop=True)
    part = pdf["part"].to_numpy()
    return pdf, np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))


def _left(sig: np.ndarray, a: np.ndarray, b: np.ndarray, need: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that no step of the comparison drops."""
    same = np.zeros(len(a), np.int64)
    for k, least in enumerate(need):
        cols = slice(k * STEP, (k + 1) * STEP)
        same += (sig[a, cols] == sig[b, cols]).sum(1)
        live = same >= least
        a, b, same = a[live], b[live], same[live]
    return a, b


def candidates(points: DataFrame, threshold: float, tolerance: float, groups: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what pruning leaves of the band buckets of
    points (key, sig)."""
    need = least_matches(threshold, tolerance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, _N)
            yield pa.record_batch([pa.array(np.repeat(np.asarray(b.column("key")), BANDS)), pa.array(_bands(sig).view(np.int64).ravel())], names=["key", "bucket"])
        c.trim()

    rows = points.mapInArrow(deal, "key long, bucket long")
    # buckets of the same members count once: their sums of two hashes agree
    size = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("low"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s")).where("size > 1")
    size = size.groupBy("size", "low", "s").agg(F.min("bucket").alias("bucket"))
    members = rows.join(size.select("bucket", "size"), "bucket")
    members = members.join(points.select("key", "sig"), "key")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, cuts = _parts(pdf)
        ids, point = np.unique(pdf["key"].to_numpy(), return_inverse=True)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, _N)
        two = (pdf["lo"] != pdf["hi"]).to_numpy()[cuts[:-1]]
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for a, b in _pairs(cuts, (pdf["own"] == pdf["hi"]).to_numpy(), two):
            a, b = _left(sig, a, b, need)
            found.append((point[a], point[b]))
        root = _forest(*map(np.concatenate, zip(*found, strict=True)), len(ids))
        tied = root != np.arange(len(ids))
        del pdf, sig, found, point
        c.trim()
        return pd.DataFrame({"a": ids[tied], "b": ids[root[tied]]})

    dealt = _deal(_blocked(members, "bucket", "size", block), groups).select("task", "part", "lo", "hi", "own", "key", "sig")
    return dealt.groupBy("task").applyInPandas(compare, "a long, b long")


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets, as a matrix product over their shingles."""
    sets = left if right is None else left + right
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    n = len(left)
    out = np.zeros((n, len(sets) - (0 if right is None else n)), np.float32)
    for lo in range(0, len(values), width):
        s, e = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(sets), min(width, len(values) - lo)), np.float32)
        m[row[s:e], at[s:e] - lo] = 1
        out += m[:n] @ (m.T if right is None else m[n:].T)
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray] | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets left[a] and right[b] (or left[b])."""
    if len(a) * 16 > len(left) * len(right or left):  # most of the pairs
        return _shared(left, right)[a, b].astype(np.float64)
    other = right or left
    return np.array([len(np.intersect1d(left[x], other[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.float64)


def verified(sets: DataFrame, threshold: float, tolerance: float, n: int, groups: int, block: int = BLOCK) -> DataFrame:
    """Rows (key, root, links, one) of members of provisional groups (key,
    group, size, copies, sig, text): its verified links (counted with the
    copies of what it is linked to) and the least member it is joined to, for
    each two blocks it stands in; ``one``: its group is a single block.  Only
    pairs that are candidates and that pruning leaves are verified."""
    need = least_matches(threshold, tolerance)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for _, h, first in _sets(b, n):
                out += [h[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
            kept = ("key", "group", "size", "copies", "sig")
            yield pa.record_batch([*(b.column(x) for x in kept), pa.array(out, pa.binary())], names=[*kept, "shingles"])
        c.trim()

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, cuts = _parts(pdf)
        keys, many, shingles = pdf["key"].to_numpy(), pdf["copies"].to_numpy(), pdf["shingles"].tolist()
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, _N)
        right, two = (pdf["own"] == pdf["hi"]).to_numpy(), (pdf["lo"] != pdf["hi"]).to_numpy()
        root, links = keys.copy(), np.zeros(len(keys), np.int64)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [np.frombuffer(x, c.U) for x in shingles[s:e]]
            size = np.array([len(x) for x in sets], np.float64)
            li = np.flatnonzero(~right[s:e]) if two[s] else np.arange(e - s)
            ri = np.flatnonzero(right[s:e]) if two[s] else li
            if not len(li) or not len(ri):
                continue
            own = sig[s:e]
            band = own.view(c.U).reshape(e - s, BANDS)
            x, y = [], []
            for k in range(0, len(li), 64):  # which pairs have a band in common
                meet = np.zeros((len(li[k : k + 64]), len(ri)), bool)
                for j in range(BANDS):
                    meet |= band[li[k : k + 64], j][:, None] == band[ri, j][None, :]
                p, q = np.nonzero(meet)
                if not two[s]:
                    p, q = p[p + k < q], q[p + k < q]
                x.append(p + k)
                y.append(q)
            a, b = li[np.concatenate(x)], ri[np.concatenate(y)]
            some = [_left(own, a[k : k + (1 << 18)], b[k : k + (1 << 18)], need) for k in range(0, len(a), 1 << 18)] or [(a, b)]
            a, b = map(np.concatenate, zip(*some, strict=True))
            at = np.zeros(e - s, np.int64)
            at[li] = np.arange(len(li))
            at[ri] = np.arange(len(ri))
            both = _common([sets[k] for k in li], [sets[k] for k in ri] if two[s] else None, at[a], at[b])
            link = both >= threshold * (size[a] + size[b] - both) - 1e-9
            a, b = a[link], b[link]
            np.add.at(links, s + a, many[s + b])
            np.add.at(links, s + b, many[s + a])
            root[s:e] = keys[s + _forest(a, b, e - s)]
        one = pdf["size"].to_numpy() <= block
        del pdf, sig, shingles
        c.trim()
        return pd.DataFrame({"key": keys, "root": root, "links": links, "one": one})

    sets = sets.select("key", "group", "size", "copies", "sig", "text").mapInArrow(shingle, "key long, group long, size long, copies long, sig binary, shingles binary")
    dealt = _deal(_blocked(sets, "group", "size", block), groups).select("task", "part", "lo", "hi", "own", "key", "size", "copies", "sig", "shingles")
    return dealt.groupBy("task").applyInPandas(verify, "key long, root long, links long, one boolean")


def _classes(df: DataFrame, doc_id: str, text: str, n: int, threshold: float, tolerance: float, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, key, tie, digest, sig) of all texts; their classes (digest,
    copies, point, first, class_id, least, links): ``first`` is the least (key,
    tie) of the class, and ``class_id`` and ``least`` that of all it is joined
    to; and the number of rows."""
    groups = max(64, 2 * c.partitions(df.sparkSession))
    docs = c.identified(df, doc_id, text)
    signed = c.cut(signatures(docs.select("id", "key", "tie", "text"), n), "signatures")
    first = F.min(F.struct("key", "tie"))
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), first.alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = c.cut(classes.withColumn("point", F.monotonically_increasing_id()), "classes")  # fixed by being written
    points = classes.select(F.col("point").alias("key"), "sig")
    found = c.components(candidates(points, threshold, tolerance, groups, block), "candidates")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    member = c.by_key(found, sizes, "root", "size", classes.count(), "inner").select(F.col("id").alias("point"), F.col("root").alias("group"), "size")
    member = member.join(classes.select("point", "first", "copies", "sig"), "point").select(F.col("point"), "group", "size", "copies", "sig", "first.*")
    texts = docs.select("key", "tie", "text").join(member, ["key", "tie"]).dropDuplicates(["point"]).drop("key", "tie").withColumnRenamed("point", "key")
    checked = c.cut(verified(texts, threshold, tolerance, n, groups, block), "verified")
    wide = c.components(checked.where("not one and key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), "links")
    near = checked.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("joined"))
    near = near.join(wide.select(F.col("id").alias("key"), F.col("root").alias("wide")), "key", "left").select(F.col("key").alias("point"), "links", F.coalesce("wide", "joined").alias("root"))
    all_ = classes.join(near, "point", "left").withColumn("root", F.coalesce("root", "point"))
    least = all_.groupBy("root").agg(F.min("id").alias("class_id"), F.min("first").alias("least"), F.count("*").alias("many"))
    all_ = c.by_key(all_.select("digest", "copies", "first", "root", "links"), least, "root", "many", classes.count(), "inner")
    return signed, c.cut(all_.select("digest", "copies", "first", "class_id", "least", F.coalesce("links", F.lit(0)).alias("links")), "joined"), signed.count()


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of ``df``: the least id it is
    connected to by links of similarity at least ``threshold``, and how many
    other rows it is linked to itself (copies included)."""
    signed, classes, total = _classes(df, doc_id, text, n, threshold, tolerance, block)
    rows = c.by_key(signed.where("digest is not null").select("id", "digest"), classes.select("digest", "copies", "class_id", "links"), "digest", "copies", total, "inner")
    full = rows.select(F.col("id").alias("doc_id"), "class_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"))
    return full.unionByName(signed.where("digest is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """One row of every class: that with the least id, of rows without one or
    with the same the one with the least hash of its text, and one of equal
    rows.  Rows of texts without words stay."""
    signed, classes, total = _classes(df, doc_id, text, n, threshold, tolerance, block)
    rows = c.by_key(signed.where("digest is not null").select("key", "tie", "digest"), classes.select("digest", "copies", "least"), "digest", "copies", total, "inner")
    gone = rows.where(F.struct("key", "tie") != F.col("least")).select("key", "tie")
    kept = c.wrapped(df, doc_id, text).join(gone.distinct(), ["key", "tie"], "left_anti")
    twice = rows.where(F.struct("key", "tie") == F.col("least")).groupBy("key", "tie").agg(F.count("*").alias("n")).where("n > 1").select("key", "tie")
    some = kept.join(twice, ["key", "tie"], "left_semi").groupBy("key", "tie").agg(F.first("rest").alias("rest"))
    return kept.join(twice, ["key", "tie"], "left_anti").select("rest.*").unionByName(some.select("rest.*"))
