"""Benchmark decontamination by winnowed fingerprints.

Of every run of ``window`` words the least hash of its ``gram``-word runs is
selected; two texts that share ``window`` words select the same fingerprint
there, so no shared span is missed.  The selected fingerprints of documents and
benchmark items are joined (about two of seven word runs are looked up at all),
and each meeting is extended to the windows that select it: those that agree
with a window of an item word by word are hit.  An item shorter than the window
is compared as a whole (its fingerprint is the item).

The benchmark's windows are broadcast while there are at most
``broadcast_rows`` of them (some 110 bytes each); beyond that both sides are
shuffled by fingerprint, then by window, with equal results.

Rows: null and empty texts and items have no words, hit nothing and are hit by
nothing; equal items all count; items without an id are one item that hits and
counts but is not named; rows of one id, or of none, are judged each by its own
text; repeated rows get equal results; further columns are not read, whatever
they are called, and :func:`decontaminate` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import common as c

WINDOW, GRAM = 10, 5


class Index(NamedTuple):
    """Of the items' windows of each length: sorted fingerprints; windows
    sorted by hash, their words, and their items (a slice of ``items``)."""

    sizes: list[int]
    prints: dict[int, np.ndarray]
    windows: dict[int, np.ndarray]
    words: dict[int, np.ndarray]
    at: dict[int, np.ndarray]
    items: dict[int, list[int | None]]


def _selected(t: c.Tokens, of: np.ndarray, size: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole runs of ``size`` words and the fingerprint of each; the places of
    the selected fingerprints, and the fingerprint at every place."""
    ok = t.whole(size, of)
    g = c.grams(t.hashes, gram if size == window else size)
    least = c.lowest(g, size - gram + 1) if size == window else g
    if size != window:
        return ok, least, np.flatnonzero(ok), g
    chosen = np.zeros(len(g), bool)
    for d in range(size - gram + 1):
        chosen[d : d + len(least)] |= (g[d : d + len(least)] == least) & ok
    return ok, least, np.flatnonzero(chosen), g


def _words(t: c.Tokens, at: np.ndarray, size: int) -> np.ndarray:
    return t.hashes[at[:, None] + np.arange(size)]


def _hash(words: np.ndarray) -> np.ndarray:
    return c.mix((words * np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(words.shape[1])], c.U)).sum(1, dtype=c.U))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _extended(t: c.Tokens, of: np.ndarray, size: int, prints: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Starts of the runs of ``size`` words whose selected fingerprint is met."""
    ok, least, chosen, g = _selected(t, of, size, window, gram)
    met = chosen[_within(g[chosen], prints)]
    back = np.arange(size - gram + 1) if size == window else np.zeros(1, int)
    start = np.unique((met[:, None] - back).ravel())
    start = start[(start >= 0) & (start < len(ok))]
    start = start[ok[start]]
    return start[_within(least[start], prints)]


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (size, print, words, item), distinct, for every window of every item."""
    letters = c.folded()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, at in c.slices(b.column("text")):
                t = c.tokens(data, at, letters)
                of, n = t.text_of(), np.diff(t.first)
                for size in sorted({min(int(x), window) for x in n if x}):
                    ok, least, _, _ = _selected(t, of, size, window, gram)
                    ok = ok & ((n[of[: len(ok)]] >= window) if size == window else (n[of[: len(ok)]] == size))
                    start = np.flatnonzero(ok)
                    for s in range(0, len(start), 1 << 16):
                        few = start[s : s + (1 << 16)]
                        words = pa.array([x.tobytes() for x in _words(t, few, size)], pa.binary())
                        yield pa.record_batch([pa.array(np.full(len(few), size, np.int32)), pa.array(least[few].view(np.int64)), words, b.column("item").take(pa.array(i + of[few]))], names=["size", "print", "words", "item"])

    src = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(windows, "size int, print long, words binary, item long").distinct()


def _index(rows: pa.Table) -> Index:
    size = np.asarray(rows["size"])
    index = Index(sorted(set(size.tolist())), {}, {}, {}, {}, {})
    for k in index.sizes:
        own = rows.filter(pa.array(size == k)).sort_by([("words", "ascending"), ("item", "ascending")])
        words = np.frombuffer(b"".join(own["words"].to_pylist()), c.U).reshape(-1, k)
        new = np.append(True, (words[1:] != words[:-1]).any(1))
        at = np.append(np.flatnonzero(new), len(words))
        h = _hash(words[new])
        order = np.argsort(h, kind="stable")
        item = own["item"].to_pylist()
        index.windows[k], index.words[k] = h[order], words[new][order]
        index.items[k] = [x for j in order for x in item[at[j] : at[j + 1]]]
        index.at[k] = np.append(0, np.cumsum(np.diff(at)[order]))
        index.prints[k] = np.unique(np.asarray(own["print"]).view(c.U))
    return index


def _found(t: c.Tokens, of: np.ndarray, index: Index, window: int, gram: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which words are hit; by size the texts, and the windows that agree."""
    edge = np.zeros(len(t.hashes) + 1, np.int32)
    met = {}
    for size in index.sizes:
        start = _extended(t, of, size, index.prints[size], window, gram)
        words = _words(t, start, size)
        spot = np.searchsorted(index.windows[size], _hash(words))
        texts, spots = [], []
        while len(start):  # windows of equal hash follow one another
            there = spot < len(index.windows[size])
            start, words, spot = start[there], words[there], spot[there]
            same = (index.words[size][spot] == words).all(1)
            np.add.at(edge, start[same], 1)
            np.add.at(edge, start[same] + size, -1)
            texts.append(of[start[same]])
            spots.append(spot[same])
            more = ~same & (index.windows[size][spot] == _hash(words))
            start, words, spot = start[more], words[more], spot[more] + 1
        if texts:
            met[size] = np.concatenate(texts), np.concatenate(spots)
    return np.cumsum(edge)[:-1] > 0, met


RESULT = "id long, n_words long, n_hit long, items array<long>"


def _scan_with(held: Broadcast, window: int, gram: int):
    """Rows (id, n_words, n_hit, items) under the index of all documents."""
    letters = c.folded()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            n_words, n_hit = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            items: list[set[int | None]] = [set() for _ in range(b.num_rows)]
            for i, j, data, at in c.slices(b.column("text")):
                t = c.tokens(data, at, letters)
                of = t.text_of()
                hit, met = _found(t, of, index, window, gram)
                n_words[i:j] = np.diff(t.first)
                n_hit[i:j] = np.bincount(of[hit], minlength=j - i)
                for size, (text, spot) in met.items():
                    for k, s in set(zip(text.tolist(), spot.tolist(), strict=True)):
                        items[i + k].update(index.items[size][index.at[size][s] : index.at[size][s + 1]])
            yield pa.record_batch([b.column("id"), pa.array(n_words), pa.array(n_hit), pa.array([list(x) for x in items], pa.list_(pa.int64()))], names=["id", "n_words", "n_hit", "items"])

    return scan


def _joined(docs: DataFrame, bench: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, key, tie, n_words, n_hit, items) by shuffles: the documents'
    fingerprints meet the benchmark's, the windows that select those that meet
    are joined with the items' windows."""
    letters = c.folded()
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most ``window`` numbers

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, tie = np.asarray(b.column("key")), np.asarray(b.column("tie"))
            for i, _, data, at in c.slices(b.column("text")):
                t = c.tokens(data, at, letters)
                of = t.text_of()
                for size in sizes:
                    _, _, chosen, g = _selected(t, of, size, window, gram)
                    row = i + of[chosen]
                    yield pa.record_batch([pa.array(key[row]), pa.array(tie[row]), pa.array(np.full(len(row), size, np.int32)), pa.array(g[chosen].view(np.int64))], names=["key", "tie", "size", "print"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("size", pa.int32()), ("words", pa.binary()), ("start", pa.int32())]))
        for b in batches:
            near = b.column("near").to_pylist()
            for k in range(b.num_rows):
                data, at = c.buffers(b.column("text").slice(k, 1))
                t = c.tokens(data, at, letters)
                out, prints = [], {}
                for r in near[k] or ():
                    prints.setdefault(r["size"], []).append(r["print"])
                for size, own in prints.items():
                    start = _extended(t, t.text_of(), size, np.unique(np.array(own, np.int64).view(c.U)), window, gram)
                    out += [{"size": size, "words": w.tobytes(), "start": s} for s, w in zip(start.tolist(), _words(t, start, size), strict=True)]
                yield pa.record_batch([*(b.column(x).slice(k, 1) for x in ("id", "key", "tie")), pa.array([len(t.hashes)], pa.int64()), pa.array([out], kind)], names=["id", "key", "tie", "n_words", "near"])

    prints = docs.select("key", "tie", "text").mapInArrow(fingerprints, "key long, tie long, size int, print long").distinct()
    met = c.salted(prints, bench.select("size", "print").distinct(), ["size", "print"])
    near = met.groupBy("key", "tie").agg(F.collect_list(F.struct("size", "print")).alias("near"))  # fingerprints of one document
    found = docs.join(near, ["key", "tie"], "left").select("id", "key", "tie", "text", "near").mapInArrow(extend, "id long, key long, tie long, n_words long, near array<struct<size:int,words:binary,start:int>>")
    found = c.cut(found, "extended")
    runs = found.select("key", "tie", F.explode("near").alias("w")).select("key", "tie", "w.*").distinct()
    runs = c.salted(runs, bench.select("size", "words").distinct(), ["size", "words"])
    before = Window.partitionBy("key", "tie").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)  # windows of one document
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    hits = runs.withColumn("fresh", fresh).groupBy("key", "tie").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = c.salted(runs.select("key", "tie", "size", "words").distinct(), bench.select("size", "words", "item").distinct(), ["size", "words"])
    items = items.groupBy("key", "tie").agg(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"]).alias("items"))
    both = found.drop("near").join(hits, ["key", "tie"], "left").join(items, ["key", "tie"], "left")
    return both.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<long>"))})


def _held(spark: SparkSession, benchmark: DataFrame, window: int, gram: int, broadcast_rows: int) -> tuple[DataFrame, Broadcast | None]:
    """The benchmark's windows as a table, and broadcast if they are few."""
    bench = c.cut(benchmark_windows(benchmark, window=window, gram=gram), "windows")
    small = bench.count() <= broadcast_rows
    return bench, spark.sparkContext.broadcast(_index(bench.toArrow())) if small else None


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = 1 << 18) -> DataFrame:
    """(id, n_words, n_hit, items) of every document: its words, those inside
    shared windows, and the ids of the items it shares them with."""
    src = c.identified(docs, doc_id, text)
    bench, held = _held(docs.sparkSession, benchmark, window, gram, broadcast_rows)
    if held is None:
        return _joined(src, bench, window, gram).select("id", "n_words", "n_hit", "items")
    return src.select("id", "text").mapInArrow(_scan_with(held, window, gram), RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: float = 0.0, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = 1 << 18) -> DataFrame:
    """Documents of which at most the share ``most`` of words is hit, as they
    are.  Under a broadcast index each task filters its rows and nothing is
    shuffled; otherwise the rows are joined against the hit documents."""
    bench, held = _held(docs.sparkSession, benchmark, window, gram, broadcast_rows)
    if held is None:
        found = _joined(c.identified(docs, doc_id, text), bench, window, gram).where(F.col("n_hit") > most * F.greatest("n_words", F.lit(1)))
        return c.wrapped(docs, doc_id, text).join(found.select("key", "tie").distinct(), ["key", "tie"], "left_anti").select("rest.*")
    letters = c.folded()

    def keep(texts: pa.Array) -> np.ndarray:
        clean = [np.zeros(0, bool)]
        for _, _, data, at in c.slices(texts):
            t = c.tokens(data, at, letters)
            of = t.text_of()
            hit, _ = _found(t, of, held.value, window, gram)
            clean.append(np.bincount(of[hit], minlength=len(at) - 1) <= most * np.maximum(np.diff(t.first), 1))
        return np.concatenate(clean)

    return c.filtered(docs, text, keep)


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row for each document: words, hit words, items and whether it is contaminated."""
    names = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return overlaps(docs, benchmark, **how).select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_FOLD = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""
_RUNS = "\n  UNION ALL ".join(
    f"SELECT doc_id, i, {k} AS k, string_agg(x, ' ') OVER r{k} AS p, count(*) OVER r{k} AS c FROM u WHERE {k} IN (SELECT k FROM b) WINDOW r{k} AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    for k in range(1, 11)
)
#: DuckDB's rows for :func:`report`.
SQL = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS w FROM documents),
t AS (SELECT item_id, {_FOLD} AS w FROM benchmark),
b AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM t WHERE len(w) > 0)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
r AS (
  {_RUNS}),
m AS (SELECT r.doc_id, r.i, r.k, b.item_id FROM r JOIN b ON r.k = b.k AND r.p = b.p WHERE r.c = r.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
