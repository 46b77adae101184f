"""Shared parts of the text operators: tokens and rolling hashes over Arrow
batches, packed exchanges, tables cut from their lineage, and components.

Tokens of a whole batch are hashed at once: each byte looks up a random word
by (position in its block of 64 bytes, value), the words of a block are added,
and the blocks of a longer token are mixed with their number before they are
added, so no Python object is made for a token.  Everything is a pure function
of the text; a task that is run again on another executor makes the same rows.

A row is known by (key, tie): its id, a null one as the largest, and a hash of
its text.  So rows without an id, and rows that share an id but not the text,
are rows of their own; rows equal in both are copies and get equal results.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.folders import scratch

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
#: The key of a row without an id.
NO_ID = (1 << 63) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a bijection)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: One random word for each (position modulo 64, byte).
_TABLE = mix((np.arange(64 * 256, dtype=U) + U(1)) * U(_ODD))


class Alphabet(NamedTuple):
    """Which bytes belong to tokens, and what each byte is read as."""

    inside: np.ndarray
    read: np.ndarray | None


def spaced() -> Alphabet:
    """Tokens ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    inside = np.ones(256, bool)
    inside[[32, *range(9, 14)]] = False
    return Alphabet(inside, None)


def folded() -> Alphabet:
    """Tokens ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    read = np.arange(256, dtype=np.uint8)
    read[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return Alphabet(inside[read], read)


class Tokens(NamedTuple):
    """Tokens of some consecutive texts: hashes, byte spans, and for each text
    the index of its first token (one more entry than texts)."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def whole(self, k: int, of: np.ndarray) -> np.ndarray:
        """For each start of ``k`` tokens: does it stay within its text?"""
        n = max(0, len(self.hashes) - k + 1)
        return np.arange(n) + k <= self.first[1:][of[:n]]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(data: np.ndarray, at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes (a longer text is a run of its own)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return runs(*buffers(texts))


def tokens(data: np.ndarray, at: np.ndarray, letters: Alphabet, most: int = 1 << 22) -> Tokens:
    """The tokens of texts; a run longer than ``most`` bytes is read in pieces
    that end between tokens, so that what is held for each byte is bounded."""
    if len(data) <= most:
        return _tokens(data, at, letters)
    parts, s = [], 0
    while s < len(data):
        e = min(len(data), s + most)
        while e < len(data) and letters.inside[data[e - 1]]:  # to the end of the token
            rest = np.flatnonzero(~letters.inside[data[e : e + most]])
            e += int(rest[0]) + 1 if len(rest) else min(most, len(data) - e)
        inner = at[(at > s) & (at < e)]
        parts.append(_tokens(data[s:e], np.concatenate([[s], inner, [e]]) - s, letters))
        parts[-1] = parts[-1]._replace(start=parts[-1].start + s, end=parts[-1].end + s)
        s = e
    h, start, end = (np.concatenate([x[k] for x in parts]) for k in range(3))
    return Tokens(h, start, end, np.searchsorted(start, at))


def _tokens(data: np.ndarray, at: np.ndarray, letters: Alphabet) -> Tokens:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, U), none, none, np.zeros(len(at), np.int64))
    inside = letters.inside[data]
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    before[at] = False  # a text begins here, whatever stood before
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(n + 1, bool)
    after[-1], after[:-1] = False, inside
    after[at] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    size = end - start
    where = np.flatnonzero(inside)
    place = where - np.repeat(start, size)
    byte = data[where] if letters.read is None else letters.read[data[where]]
    part = _TABLE[((place & 63) << 8) | byte]
    if not len(start):
        h = np.zeros(0, U)
    elif size.max() <= 64:
        h = mix(np.add.reduceat(part, np.cumsum(size) - size))
    else:
        heads = np.flatnonzero((place & 63) == 0)
        block = place[heads] >> 6
        sums = np.add.reduceat(part, heads)
        later = np.repeat(size > 64, (size + 63) >> 6)  # blocks of tokens that have several
        sums[later] = mix(sums[later] + (block[later].astype(U) + U(1)) * U(_ODD))
        h = mix(np.add.reduceat(sums, np.flatnonzero(block == 0)))
    return Tokens(h, start, end, np.searchsorted(start, at))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` tokens, by doubling."""
    n, want, done, out, cur, width = len(h), k, 0, None, h, 1
    if n < k:
        return np.zeros(0, U)
    while want:
        if want & 1:
            part = cur[done : done + n - k + 1] * U(pow(_ODD, done, 1 << 64))
            out = part if out is None else out + part
            done += width
        want >>= 1
        if want:
            cur = cur[:-width] + cur[width:] * U(pow(_ODD, width, 1 << 64))
            width *= 2
    return mix(out)


def lowest(a: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` consecutive ones."""
    if len(a) < w:
        return a[:0]
    width = 1
    cur = a
    while width * 2 <= w:
        cur = np.minimum(cur[:-width], cur[width:])
        width *= 2
    return cur if width == w else np.minimum(cur[: len(a) - w + 1], cur[w - width : w - width + len(a) - w + 1])


def by_part(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each part, in the order they have."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for s, e in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[s]), [c[order[s:e]] for c in columns]


def pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, which the shuffle's codec shrinks well."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def unpack(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def unpack_all(blobs, sizes, *kinds: type) -> list[np.ndarray]:
    parts = [unpack(b, n, *kinds) for b, n in zip(blobs, sizes, strict=True)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


PACKED = "part int, n int, blob binary"


try:
    _give_back = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # of the C library of Linux
    _give_back = None


def trim() -> None:
    """Give the memory that this worker holds but does not use back to the
    machine: workers stay for the next stages, beside those that run there."""
    pa.default_memory_pool().release_unused()
    if _give_back:
        _give_back(0)


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["part", "n", "blob"],
    )


def identified(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, tie, text) of each row of ``df``; see the top of this module."""
    src = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.select("id", F.coalesce("id", F.lit(NO_ID)).alias("key"), _tie("text").alias("tie"), "text")


def _tie(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def plain(df: DataFrame, doc_id: str) -> bool:
    """Has every row of ``df`` an id of its own?  Then no tie is needed."""
    ids = df.select(F.col(doc_id).cast("long").alias("id"))
    return ids.groupBy("id").count().where("count > 1 or id is null").isEmpty()


def wrapped(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rest, key, tie): each row of ``df`` as a struct, whatever its columns
    are called, and what it is known by."""
    return df.select(F.struct("*").alias("rest"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), _tie(text).alias("tie"))


def filtered(df: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``df`` for whose texts ``keep`` says so, as they are.  The rows
    go through the tasks as structs, so that their names may be any, and the
    text is read from there, so that it goes once."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field(at)
            yield b.filter(pa.array(keep(texts if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts.cast(pa.string())), pa.bool_()))
        trim()

    src = df.select(F.struct("*").alias("rest"))
    return src.mapInArrow(run, src.schema).select("rest.*")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows does
    not depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame) -> None:
    """Remove what :func:`cut` wrote for ``df``, which nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_key(rows: DataFrame, found: DataFrame, key: str, many: str, total: int, how: str = "left", hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``found``, which has one row for each ``key`` and in
    ``many`` how many of the ``total`` rows have it.  Keys of more than one
    ``hot``-th of all rows are at most ``hot``, so these are broadcast and their
    rows stay where they are; the others are shuffled."""
    large = found.where(F.col(many) * hot > total)
    small = found.where(F.col(many) * hot <= total)
    near = rows.join(F.broadcast(large), key)  # at most ``hot`` rows
    far = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key, how)
    return near.unionByName(far)


def salted(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``found`` by ``keys``, of which one may be that of
    very many rows: these are spread over ``salts`` partitions."""
    spread = F.pmod(F.xxhash64(*[x for x in rows.columns if x not in keys]), F.lit(salts)).cast("int")
    return rows.withColumn("salt", spread).join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "salt"], how).drop("salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (id, root), the
    root being the least id of the component.  Large-star and small-star turns
    alternate; each turn is a written table that takes the place of the one
    before, and no vertex list is collected.  The minimum over neighbours is a
    partial aggregate, and the edges of a hub are spread when it is joined.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    e = cut(edges.where("a <> b").select(pair("a", "b").alias("p")).select("p.*").distinct(), name)
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: the larger neighbours of a point to its least neighbour
        large = salted(both.where("b > a"), low, ["a"], salts=4).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted(large, least, ["a"], salts=4).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        old, e = e, cut(small, name)
        drop(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == last or now["n"] == 0:
            break
        last = now
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return roots.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
