"""One shared dictionary of many patterns looked up in all texts.

Three bit maps of the dictionary go to all tasks: of the anchors (the first four
characters of a pattern, fewer if it is shorter, without regard to case), of anchors
with the lengths of their patterns, and of whole patterns.  A task hashes all
positions of many texts at once; what passes the three becomes a row, once for
each text and slice, with the slice and what stands around it.  Those rows meet
the dictionary in a join by the whole pattern (Spark broadcasts a small dictionary
and shuffles a large one, with equal results), so patterns that begin alike cost
no more than others.

Rows: null and empty texts and patterns match nothing; of equal patterns of one
seed the first counts; texts and seeds are known by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.folders import written

ANCHOR = 4  # characters
BITS = 1 << 20  # of the maps of anchors
MOST = 1 << 28  # of the map of whole patterns, which has 16 for each while they fit
BLOCK = 1 << 15  # bits that one row holds
CHUNK = 1 << 18  # characters hashed at once
SHORT = 3  # patterns up to here need the edges of words
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_END = 0x110000  # no character: stands after each text


def lowered(text: str) -> str:
    """Lower case, one character for each."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(29))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` characters."""
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        h = (h + codes[k : k + len(h)] + np.uint64(n)) * np.uint64(_ODD)
    return _mixed(h)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """What ``_whole`` needs of a text: the sum before each place."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes + np.uint64(1)) * _powers(_ODD, len(codes)), dtype=np.uint64)])


def _whole(sums: np.ndarray, back: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` characters at some places, in equal time for any length."""
    return _mixed((sums[at + n] - sums[at]) * back[at] + np.uint64(n))


def _with_size(grams: np.ndarray, n: int) -> np.ndarray:
    return _mixed(grams + np.uint64(n * _ODD % (1 << 64)))


def _has(bits: np.ndarray, h: np.ndarray, places: tuple[int, ...] = (0,)) -> np.ndarray:
    """Are the bits of these hashes set?"""
    ok = np.ones(len(h), bool)
    for shift in places:
        k = (h >> np.uint64(shift)) & np.uint64(len(bits) * 8 - 1)
        ok &= (bits[(k >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (k & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return ok


_TWO = (0, 32)  # a whole pattern sets two bits


def anchors(patterns: DataFrame) -> DataFrame:
    """Patterns (seed_id, place, pattern) with ``low``, ``size`` and the hashes of their
    anchor, of that with the length, and of the whole, as tasks write them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [lowered(x) for x in b.column("pattern").to_pylist()]
            size = np.array([len(x) for x in low], np.int64)
            codes = _codes("".join(low))
            start = np.cumsum(size) - size
            sums, back = _sums(codes), _powers(_BACK, len(codes))
            grams = {m: _grams(codes, m) for m in {min(n, ANCHOR) for n in size.tolist()}}
            first, sized, whole = (np.zeros(len(low), np.uint64) for _ in range(3))
            for n in np.unique(size).tolist():
                k = np.flatnonzero(size == n)
                first[k] = grams[min(n, ANCHOR)][start[k]]
                sized[k] = _with_size(first[k], n)
                whole[k] = _whole(sums, back, start[k], n)
            yield pa.record_batch([*b.columns, pa.array(low, pa.string()), pa.array(size.astype(np.int32)), *[pa.array(h.view(np.int64)) for h in (first, sized, whole)]], names=[*b.schema.names, "low", "size", "first", "sized", "whole"])

    p = patterns.where("pattern is not null and pattern <> ''").select("seed_id", F.col("place").cast("int").alias("place"), "pattern")
    kind = p.schema["seed_id"].dataType.simpleString()
    return p.mapInArrow(run, f"seed_id {kind}, place int, pattern string, low string, size int, first long, sized long, whole long")


def _maps(found: DataFrame, bits: int) -> list[np.ndarray]:
    """The three bit maps, put together by blocks in tasks."""

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(BLOCK, bool)
        flags[own["bit"].to_numpy()] = True
        return pd.DataFrame({"map": own["map"].iloc[:1], "block": own["block"].iloc[:1], "bytes": [np.packbits(flags).tobytes()]})

    place = lambda c, shift, size: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(size - 1))
    rows = [(0, place("first", 0, BITS)), (1, place("sized", 0, BITS)), *[(2, place("whole", shift, bits)) for shift in _TWO]]
    each = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("map"), p.alias("p")) for k, p in rows])).alias("x")).select("x.map", "x.p").distinct()
    blocks = each.select("map", F.expr(f"cast(p div {BLOCK} as int)").alias("block"), F.expr(f"cast(p % {BLOCK} as int)").alias("bit"))
    out = [np.zeros(n // 8, np.uint8) for n in (BITS, BITS, bits)]
    for r in blocks.groupBy("map", "block").applyInPandas(packed, "map int, block int, bytes binary").toLocalIterator():
        own = np.frombuffer(bytes(r["bytes"]), np.uint8)
        out[r["map"]][r["block"] * len(own) : (r["block"] + 1) * len(own)] = own
    return out


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _edge(text: str, at: int) -> bool:
    """Does a word begin or end before the character ``at``?"""
    before = 0 < at <= len(text) and _is_word(text[at - 1])
    return before != (at < len(text) and _is_word(text[at]))


def scan(texts: DataFrame, patterns: DataFrame, document_id: str = "document_id", text: str = "text", context: int = 40) -> DataFrame:
    """(document_id, seed_id, candidate, start, context): for every text and seed of
    patterns (seed_id, place, pattern) the first pattern, by ``place``, that the text
    holds, where it stands first, and what stands around it.  Patterns of up to
    three characters have to begin and end at edges of words."""
    spark = texts.sparkSession
    found = written(anchors(patterns), "patterns")  # read several times
    known = found.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    bits = min(MOST, max(BITS, 1 << (16 * known["n"]).bit_length()))
    sizes = known["sizes"]  # lengths, not patterns
    sent = spark.sparkContext.broadcast(_maps(found, bits))
    own = texts.select(F.col(document_id).alias("document_id"), F.col(text).cast("string").alias("text")).where("document_id is not null and text is not null")
    kind = own.schema["document_id"].dataType.simpleString()

    def spots_of(chunk: list[tuple[int, str]]) -> Iterator[tuple]:
        """(row, slice, start, context) of texts: what may be a pattern, where it first stands."""
        firsts, sized, whole = sent.value
        lows = [lowered(t) for _, t in chunk]
        codes = np.concatenate([x for low in lows for x in (_codes(low), np.array([_END], np.uint64))])
        ends = np.cumsum([len(low) + 1 for low in lows])
        sums, back = _sums(codes), _powers(_BACK, len(codes))
        grams = {m: _grams(codes, m) for m in {min(n, ANCHOR) for n in sizes}}
        near = {m: np.flatnonzero(_has(firsts, g)) for m, g in grams.items()}
        for n in sizes:
            m = min(n, ANCHOR)
            at = near[m][near[m] + n <= len(codes)]
            at = at[_has(sized, _with_size(grams[m][at], n))]
            at = at[_has(whole, _whole(sums, back, at, n), _TWO)]
            seen: set[tuple[int, str]] = set()
            for k, a in zip(np.searchsorted(ends, at, "right").tolist(), at.tolist(), strict=True):
                (row, t), low = chunk[k], lows[k]
                a -= int(ends[k]) - len(low) - 1
                piece = low[a : a + n]
                if len(piece) == n and (k, piece) not in seen and (n > SHORT or _edge(low, a) and _edge(low, a + n)):
                    seen.add((k, piece))
                    yield row, piece, a, t[max(0, a - context) : a + n + context]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written_out(b: pa.RecordBatch, chunk: list[tuple[int, str]]) -> pa.RecordBatch:
            rows = list(spots_of(chunk))
            cols = [pa.array([r[j] for r in rows], x) for j, x in ((1, pa.string()), (2, pa.int32()), (3, pa.string()))]
            return pa.record_batch([b.column("document_id").take(pa.array([r[0] for r in rows], pa.int64())), *cols], names=["document_id", "low", "start", "context"])

        for b in batches:
            chunk, size = [], 0
            for k, t in enumerate(b.column("text")):
                chunk.append((k, t.as_py()))
                size += len(chunk[-1][1]) + 1
                if size >= CHUNK or k == b.num_rows - 1:
                    yield written_out(b, chunk)
                    chunk, size = [], 0

    spots = own.mapInArrow(run, f"document_id {kind}, low string, start int, context string")
    both = spots.join(found.select("seed_id", "place", "pattern", "low"), "low")
    first = both.groupBy("document_id", "seed_id").agg(F.min(F.struct("place", "start", "pattern", "context")).alias("l"))
    return first.select("document_id", "seed_id", F.col("l.pattern").alias("candidate"), F.col("l.start").alias("start"), F.col("l.context").alias("context"))
