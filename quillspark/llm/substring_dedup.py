"""Removal of long repeated word sequences (prefix-partitioned suffix trees).

A suffix is the words of a document from one of its positions on.  Suffixes
that share ``window`` words lie below one internal node of that depth or more
of the suffix tree, and all but the earliest of them are repeats.  The tree of
the corpus is never held whole:

* *Anchors.*  In each window the least of its ``anchor``-word hashes is chosen,
  so equal windows choose equal anchors.  A first pass finds the anchors that
  the corpus repeats; no window of another can lie below a deep node.
* *Partitioning.*  A slice is the words of neighbouring windows of one anchor.
  Slices are dealt to groups by the words of the anchor, a prefix of
  ``anchor`` words of the suffix that begins there.  Where the suffixes below
  one prefix are too many for a group the prefix is lengthened to all words of
  the window, and its windows are dealt one by one.  The groups grow in number
  with the text, so that each fits in the memory of one task.
* *Subtrees.*  Each group is a suffix array to the depth of its slices, made by
  doubling ranks of words (ranks, not hashes, are compared), with the common
  prefixes of neighbours.  Runs of neighbours that share ``window`` words or
  more are the deep internal nodes; the windows that begin later in them join,
  document by document, to the maximal repeats.

Slices are sent as compressed bytes and read again in their group.  Before
that each batch keeps the earliest suffix of a node only (word by word the
same; the later ones repeat in any case), so that a passage held by a third of
all documents reaches its group once a batch and not once a document.

Rows: null and empty texts have no words and lose none; a document shorter
than the window keeps all; equal texts keep one whole copy (the least id).  A
null id comes after all others; rows of one id and different texts are
documents of their own, in the order of a hash of the text; rows equal in id
and text are copies of one row and lose the same words.  Further columns are
not read, whatever they are called, and :func:`strip_documents` returns them.
Two words are taken for equal if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common as c

ROOM = 1 << 19  # words that one group is meant for
POOL = 1 << 24  # bytes of slices that a task holds before it sends them
_HOT = -1 << 30  # the part of rows that name hot anchors


class _Places:
    """Rows (key, tie, value), one document after another."""

    def __init__(self, key: np.ndarray, tie: np.ndarray, value: np.ndarray):
        self.key, self.tie, self.value = key, tie, value

    def rows(self, groups: int, sign: int = 1) -> Iterator[tuple[int, int, bytes]]:
        """Packed rows for the gathering by document, dealt to ``groups`` parts."""
        part = (c.mix(self.key.view(c.U) + self.tie.view(c.U) * c.U(3)) % c.U(groups)).astype(np.int64)
        for p, x in c.by_part(part, self.key, self.tie, self.value):
            yield (p if sign > 0 else -1 - p), len(x[0]), c.pack(*x)


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["part", "n", "blob"])


def _gather(packed: DataFrame, name: str, runs: bool = False) -> DataFrame:
    """One row for each document: its 32-bit values, sorted and distinct, or as
    runs of following ones (the first of each and how many)."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        key, tie, value = c.unpack_all(pdf["blob"], pdf["n"], np.int64, np.int64, np.uint32)
        order = np.lexsort((value, tie, key))
        key, tie, value = key[order], tie[order], value[order]
        doc = np.ones(len(key), bool)
        doc[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])
        new = doc.copy()
        new[1:] |= value[1:] != value[:-1]
        key, tie, value, doc = key[new], tie[new], value[new], doc[new]
        if runs:
            head = doc.copy()
            head[1:] |= value[1:] != value[:-1] + np.uint32(1)
            at = np.flatnonzero(head)
            value = np.stack([value[at], np.diff(np.append(at, len(value))).astype(np.uint32)], 1)
            key, tie, doc = key[at], tie[at], doc[at]
        cuts = np.flatnonzero(doc)
        ends = np.append(cuts[1:], len(key))
        found = pd.DataFrame({"key": key[cuts], "tie": tie[cuts], name: [value[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)]})
        del pdf, key, tie, value, doc, new, order
        c.trim()
        return found

    return packed.groupBy("part").applyInPandas(gather, f"key long, tie long, {name} binary")


def _half(h: np.ndarray) -> np.ndarray:
    return (h >> c.U(32)).astype(np.uint32)


def _anchored(t: c.Tokens, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole windows, the text and anchor hash of every window, anchor-gram hashes."""
    of = t.text_of()
    g = c.grams(t.hashes, anchor)
    return t.whole(window, of), of, c.lowest(g, window - anchor + 1), g


def _repeated_anchors(docs: DataFrame, window: int, anchor: int, groups: int, hot: int) -> tuple[DataFrame, np.ndarray]:
    """(key, tie, anchors): half of the hash of each anchor of a document that
    the corpus repeats (one kept for nothing does no harm); and the anchors that
    it has more than ``hot`` times."""
    letters = c.spaced()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, tie = np.asarray(b.column("key")), np.asarray(b.column("tie"))
            hs, rs = [], []
            for i, _, data, at in c.slices(b.column("text")):
                t = c.tokens(data, at, letters)
                ok, of, m, g = _anchored(t, window, anchor)
                if not ok.any():
                    continue
                chosen = np.zeros(len(g), bool)
                for d in range(window - anchor + 1):
                    chosen[d : d + len(m)] |= (g[d : d + len(m)] == m) & ok
                at_ = np.flatnonzero(chosen)
                hs.append(g[at_])
                rs.append(i + of[at_])
            if not hs:
                continue
            h, row = np.concatenate(hs), np.concatenate(rs)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            many = np.diff(np.append(np.flatnonzero(first), len(h)))
            again = np.repeat(many > 1, many)  # the batch itself repeats it
            out = list(_Places(key[row[again]], tie[row[again]], _half(h[again])).rows(groups, -1))
            row = row[first]
            for p, x in c.by_part((h[first] >> c.U(40)).astype(np.int64) % groups, h[first], many.astype(np.int32), key[row], tie[row]):
                out.append((p, len(x[0]), c.pack(*x)))
            yield c.packed_batch(out)
            del out, h, row, hs, rs
        c.trim()

    def decide(part: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if part[0] < 0:
            return pdf.assign(part=-1 - pdf["part"])
        h, many, key, tie = c.unpack_all(pdf["blob"], pdf["n"], c.U, np.int32, np.int64, np.int64)
        h, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, many)
        again = (total[at] > 1) & (many == 1)  # the others are on their way already
        over = np.flatnonzero(total > hot)
        out = list(_Places(key[again], tie[again], _half(h[at[again]])).rows(groups))
        del pdf, many, key, tie, at, again
        c.trim()
        return _frame([*out, (_HOT, len(over), h[over].tobytes())] if len(over) else out)

    decided = c.cut(docs.select("key", "tie", "text").mapInArrow(collect, c.PACKED).groupBy("part").applyInPandas(decide, c.PACKED), "anchors")
    # an anchor that is hot fills a group, so there are fewer than groups
    over = np.sort(np.frombuffer(b"".join(r["blob"] for r in decided.where(F.col("part") == _HOT).collect()), c.U))
    return _gather(decided.where(F.col("part") >= 0), "anchors"), over


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """The bytes of ranges one after another, taken about ``most`` at a time."""
    out, upto = [np.zeros(0, np.uint8)], np.append(0, np.cumsum(size))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        out.append(data[np.repeat(start[i:j] - (upto[i:j] - upto[i]), size[i:j]) + np.arange(upto[j] - upto[i])])
        i = j
    return np.concatenate(out)


class _Pool:
    """Windows of a run of texts, and what is sent of them."""

    def __init__(self, window: int, groups: int, over: np.ndarray):
        self.window, self.groups, self.over = window, groups, over
        self.clear()

    def clear(self) -> None:
        self.hashes, self.data, self.windows, self.base, self.size = [], [], [], 0, 0

    def add(self, t: c.Tokens, data: np.ndarray, at: np.ndarray, anchor: np.ndarray, key: np.ndarray, tie: np.ndarray, place: np.ndarray) -> None:
        """The windows that begin at the tokens ``at``."""
        path = c.grams(t.hashes, self.window)[at]
        self.windows.append((at + self.base, path, anchor, key, tie, place.astype(np.uint32), self.size + t.start[at], self.size + t.end[at + self.window - 1]))
        self.hashes.append(t.hashes)
        self.data.append(data)
        self.base += len(t.hashes)
        self.size += len(data)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.windows:
            return
        word = np.concatenate(self.hashes)
        at, path, anchor, key, tie, place, start, end = map(np.concatenate, zip(*self.windows, strict=True))
        order = np.lexsort((place, tie, key, path))
        head = np.append(True, path[order][1:] != path[order][:-1])
        head = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        first = np.empty(len(at), np.int64)
        first[order] = head
        same = first != np.arange(len(at))
        for d in range(self.window):  # word by word
            same &= word[at + d] == word[at[first] + d]
        other = (key != key[first]) | (tie != tie[first]) | (place != place[first])
        again = same & other
        yield from _Places(key[again], tie[again], place[again]).rows(self.groups, -1)
        keep = np.flatnonzero(~same)
        at, path, anchor, key, tie, place, start, end = (x[keep] for x in (at, path, anchor, key, tie, place, start, end))
        alone = _within(anchor, self.over)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | alone[1:] | (place[1:] != place[:-1] + np.uint32(1))
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(at)) - 1
        group = (c.mix(np.where(alone[s], path[s], anchor[s])) % c.U(self.groups)).astype(np.int64)
        data = np.concatenate(self.data)
        for g, (lo, hi) in c.by_part(group, s, e):
            size = end[hi] - start[lo]
            raw = c.pack(np.diff(key[lo], prepend=np.int64(0)), tie[lo], place[lo], size.astype(np.int32)) + _bytes(data, start[lo], size).tobytes()
            yield g, len(lo), len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _slices(blobs, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, tie and place of each slice; bytes and offsets of their words."""
    parts, data = [], []
    for blob, n in zip(blobs, sizes, strict=True):
        raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
        step, tie, place, size = c.unpack(raw, n, np.int64, np.int64, np.uint32, np.int32)
        parts.append((np.cumsum(step), tie, place, size))
        data.append(np.frombuffer(raw, np.uint8, offset=24 * n))
    key, tie, place, size = map(np.concatenate, zip(*parts, strict=True))
    return key, tie, place, np.concatenate(data), np.append(0, np.cumsum(size, dtype=np.int64))


def suffix_array(word: np.ndarray, at: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the suffixes that begin at ``at`` by their first ``window``
    words, and a function of neighbours: the words (up to twice as many less
    one, and not beyond ``end``) that two of them share."""
    levels = [np.unique(word, return_inverse=True)[1]]
    k = 1
    while 2 * k <= window:
        r = levels[-1]
        r2 = np.zeros(len(word), np.int64)
        if len(word) > k:
            r2[:-k] = np.unique(r[:-k] * np.int64(len(word) + 1) + r[k:], return_inverse=True)[1]
        levels.append(r2)
        k *= 2
    rank = levels[-1][at] * np.int64(len(word) + 1) + levels[-1][at + window - k]

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of suffixes number ``a`` and ``b``."""
        n = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            k = 1 << level
            x, y = at[a] + n, at[b] + n
            fits = np.flatnonzero((x + k <= end[a]) & (y + k <= end[b]))
            n[fits[levels[level][x[fits]] == levels[level][y[fits]]]] += k
        return n

    return rank, shared


def _repeats(docs: DataFrame, anchors: DataFrame, over: np.ndarray, window: int, anchor: int, groups: int) -> DataFrame:
    """(key, tie, starts): starts of the windows of each document that begin earlier elsewhere."""
    letters = c.spaced()
    held = docs.sparkSession.sparkContext.broadcast(over)  # fewer than groups

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(window, groups, held.value)
        for b in batches:
            key, tie, known = np.asarray(b.column("key")), np.asarray(b.column("tie")), b.column("anchors")
            for i, j, data, at in c.slices(b.column("text")):
                t = c.tokens(data, at, letters)
                ok, of, m, _ = _anchored(t, window, anchor)
                for k in range(i, j):
                    lo, hi = t.first[k - i], min(t.first[k - i + 1], len(m))
                    blob = known[k].as_py() if ok[lo:hi].any() else None
                    ok[lo:hi] &= _within(_half(m[lo:hi]), np.frombuffer(blob, np.uint32)) if blob else False
                at_ = np.flatnonzero(ok)
                if len(at_):
                    row = i + of[at_]
                    pool.add(t, data, at_, m[at_], key[row], tie[row], at_ - t.first[of[at_]])
                    if pool.size > POOL:
                        yield c.packed_batch(list(pool.rows()))
                        pool.clear()
                        c.trim()
        yield c.packed_batch(list(pool.rows()))
        pool.clear()
        c.trim()

    def subtree(part: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if part[0] < 0:
            return pdf.assign(part=-1 - pdf["part"])
        key, tie, place, data, cut = _slices(pdf["blob"], pdf["n"])
        del pdf
        words, ofs = [], []
        for i, _, some, at in c.runs(data, cut):
            t = c.tokens(some, at, letters)
            words.append(t.hashes)
            ofs.append(i + t.text_of())
        word, of = np.concatenate(words), np.concatenate(ofs)
        first = np.searchsorted(of, np.arange(len(key) + 1))
        at = np.arange(max(0, len(word) - window + 1))
        at = at[at + window <= first[of[at] + 1]]
        own = of[at]
        place = place[own] + (at - first[own]).astype(np.uint32)
        rank, shared = suffix_array(word, at, first[own + 1], window)
        key, tie = key[own], tie[own]
        order = np.lexsort((place, tie, key, rank))
        depth = shared(order[:-1], order[1:])  # of the node above each two neighbours
        head = np.maximum.accumulate(np.where(np.append(True, depth < window), np.arange(len(order)), 0))
        key, tie, place = key[order], tie[order], place[order]
        later = (key != key[head]) | (tie != tie[head]) | (place != place[head])
        found = _Places(key[later], tie[later], place[later])
        del words, ofs, word, of, at, own, rank, shared, order, depth, head
        c.trim()
        return _frame(found.rows(groups))

    joined = docs.select("key", "tie", "text").join(anchors, ["key", "tie"], "left")
    packed = joined.select("key", "tie", "text", "anchors").mapInArrow(emit, c.PACKED).groupBy("part").applyInPandas(subtree, c.PACKED)
    return _gather(packed, "starts", runs=True)


def removed_windows(docs: DataFrame, window: int = 20, room: int = ROOM) -> DataFrame:
    """(key, tie, starts) of identified documents (see common): as packed
    32-bit integers the runs of the windows that begin earlier elsewhere (the
    word at which the first begins, and their number); only documents that have
    some.  ``room``: words of a group.
    """
    anchor = max(1, window // 2)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(max(c.partitions(docs.sparkSession), size // (8 * room)))
    anchors, over = _repeated_anchors(docs, window, anchor, groups, max(1, room // 32))
    return _repeats(docs, anchors, over, window, anchor, groups)


def covered(n: int, starts: bytes | None, window: int) -> np.ndarray | None:
    """Which of ``n`` words a removed window covers; None if no one does."""
    if not starts:
        return None
    first, many = np.frombuffer(starts, np.uint32).reshape(-1, 2).astype(np.int64).T
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + many - 1 + window, -1)
    return np.cumsum(edge)[:n] > 0


def _stripped(texts: pa.Array, starts: pa.Array, window: int) -> tuple[list, list[int], list[int]]:
    """Texts without their repeated windows, words, and words taken out."""
    letters = c.spaced()
    out, n, gone = [], [], []
    for raw, mine in zip(texts.cast(pa.binary()).to_pylist(), starts.to_pylist(), strict=True):
        if mine is None:
            out.append(raw)
            n.append(len((raw or b"").split()))
            gone.append(0)
            continue
        data = np.frombuffer(raw, np.uint8)
        t = c.tokens(data, np.array([0, len(data)]), letters)
        off = covered(len(t.start), mine, window)
        nxt = np.append(t.start[1:], len(data))
        out.append(b"".join(raw[s:e] for s, e in zip(t.start[~off], nxt[~off], strict=True)).rstrip(b" \t\n\x0b\x0c\r"))
        n.append(len(off))
        gone.append(int(off.sum()))
    return out, n, gone


def _documents(df: DataFrame, doc_id: str, text: str, plain: bool | None = None) -> DataFrame:
    docs = c.identified(df, doc_id, text)
    return docs.withColumn("tie", F.lit(0).cast("long")) if plain or plain is None and c.plain(df, doc_id) else docs


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, room: int = ROOM) -> DataFrame:
    """Each document without the words of repeated windows.

    Returns (doc_id, text, n_words, n_removed): the text has its own white
    space where nothing is taken out; a null text stays null.
    """
    docs = _documents(df, doc_id, text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, gone = _stripped(b.column("text"), b.column("starts"), window)
            yield pa.record_batch([b.column("id"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    both = docs.join(removed_windows(docs, window, room), ["key", "tie"], "left")
    return both.select("id", "text", "starts").mapInArrow(strip, "doc_id long, text string, n_words long, n_removed long")


def strip_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = 20, room: int = ROOM) -> DataFrame:
    """``df`` with its repeated windows taken out of the texts and ``n_chars``
    counted anew; a document of which no word is left goes.  All columns and
    their order stay; rows that lose nothing stay as they are."""
    plain = c.plain(df, doc_id)
    docs = _documents(df, doc_id, text, plain)
    src = c.wrapped(df, doc_id, text)
    src = (src.withColumn("tie", F.lit(0).cast("long")) if plain else src).withColumn("text", F.col(f"rest.`{text}`").cast("string")).withColumn("rest", F.col("rest").dropFields(f"`{text}`"))
    both = src.join(removed_windows(docs, window, room), ["key", "tie"], "left").select("rest", "text", "starts")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, gone = _stripped(b.column("text"), b.column("starts"), window)
            part = pa.array([g > 0 for g in gone], pa.bool_())
            left = pa.array([not g or g < k for g, k in zip(gone, n, strict=True)], pa.bool_())
            yield pa.record_batch([b.column("rest"), pa.array(out, pa.binary()).cast(pa.string()), part], names=["rest", "text", "part"]).filter(left)
        c.trim()

    done = both.mapInArrow(strip, T.StructType([src.schema["rest"], T.StructField("text", T.StringType()), T.StructField("part", T.BooleanType())]))
    new = {text: F.col("text"), n_chars: F.when(F.col("part"), F.length("text")).otherwise(F.col(f"rest.`{n_chars}`")) if n_chars in df.columns else None}
    return done.select(*[(new[x] if x in new else F.col(f"rest.`{x}`")).cast(df.schema[x].dataType).alias(x) for x in df.columns])


def digests(df: DataFrame, window: int = 20, room: int = ROOM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    docs = _documents(df, "doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for raw, starts in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = (raw or b"").split()
                off = covered(len(words), starts, window)
                n.append(len(words))
                gone.append(0 if off is None else int(off.sum()))
                sha.append(hashlib.sha256(b" ".join(words if off is None else compress(words, ~off))).hexdigest())
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    both = docs.join(removed_windows(docs, window, room), ["key", "tie"], "left")
    return both.select("id", "text", "starts").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: DuckDB's rows for :func:`digests` over ``documents``.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
r AS (
  SELECT doc_id, i AS s, string_agg(x, ' ') OVER v AS p, count(*) OVER v AS n FROM u
  WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY p ORDER BY doc_id, s) AS nth FROM r WHERE n = 20),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM k WHERE nth > 1),
kept AS (
  SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM u ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
