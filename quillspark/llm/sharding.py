"""Shards by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text are a group, which no shard divides.  A group of more
than a ``GRAIN``-th of all bytes is an item of its own; the others are summed to
bundles by the hash of their text, so at most 2 * ``GRAIN`` items are packed,
however many documents there are, and the packing is the one step that is not
spread.  Items enter by size, the largest first, the bin with the least
room that holds them; the rooms are kept in a balanced tree, so an item costs
the logarithm of the bins.

Two uses: :func:`pack` fills as few bins of a fixed capacity as best fit finds
(an item above the capacity has a bin of its own), and :func:`shards` has a
number of shards and takes the least capacity with which they suffice, so that
their sizes are near equal.  Groups that exceed an equal share of what is left
get a shard each, and the others share the rest.

Within a shard, documents are numbered without gaps in the order of a hash of id
and text: ranges of the hash are counted, the counts summed up, and a window
numbers each range, so no task holds a shard and no group stays together there.

Rows: a null text has no bytes and is a group with the empty ones, each
document weighing ``OVERHEAD`` all the same; null ids and repeated rows are documents
like others (which of equal rows gets which slot makes no difference); further
columns are not read, whatever they are called; an empty table gives no rows;
more shards than groups leave the last ones empty.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import by_key, cut

#: Bytes that a document weighs besides its text.
OVERHEAD = 16
#: A group of more than this part of all bytes is packed by itself.
GRAIN = 1 << 15
#: Rows of a range in which slots are numbered, about.
RANGE = 1 << 16


class Rooms:
    """Bins by remaining room, in a balanced tree of two levels: leaves of at
    most ``2 * WIDTH`` sorted pairs, halved when full, under their greatest pairs."""

    WIDTH = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.greatest: list[tuple[int, int]] = []

    def add(self, room: int, bin_: int) -> None:
        if not self.leaves:
            self.leaves, self.greatest = [[(room, bin_)]], [(room, bin_)]
            return
        k = min(bisect_left(self.greatest, (room, bin_)), len(self.leaves) - 1)
        leaf = self.leaves[k]
        insort(leaf, (room, bin_))
        if len(leaf) > 2 * self.WIDTH:
            self.leaves[k : k + 1] = [leaf[: self.WIDTH], leaf[self.WIDTH :]]
            self.greatest[k : k + 1] = [leaf[self.WIDTH - 1], leaf[-1]]
        else:
            self.greatest[k] = leaf[-1]

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room for ``size``, of equal ones the first."""
        k = bisect_left(self.greatest, (size, -1))
        if k == len(self.leaves):
            return None
        leaf = self.leaves[k]
        found = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.greatest[k] = leaf[-1]
        else:
            del self.leaves[k], self.greatest[k]
        return found


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item of ``sizes`` (largest first); none if more than
    ``most`` bins are needed.  An item above the capacity fills a bin."""
    rooms, out, n = Rooms(), [], 0
    for size in sizes:
        room, bin_ = rooms.tightest(size) or (max(capacity, size), n)
        if bin_ == n:
            n += 1
            if most is not None and n > most:
                return None
        rooms.add(room - size, bin_)
        out.append(bin_)
    return out


def near_equal(sizes: list[int], bins: int) -> list[int]:
    """The bin of each item of ``sizes`` (largest first): items of at least an
    equal share of what is left alone, the rest by best fit with the least
    capacity that needs no more bins."""
    left, alone = sum(sizes), 0
    while alone < min(len(sizes), bins - 1) and sizes[alone] * (bins - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, bins_left = sizes[alone:], bins - alone
    if not rest:
        return list(range(alone))
    low = max(-(-left // bins_left), rest[0])
    step, found = 0, best_fit(rest, low, bins_left)
    while found is None:  # at the latest when an item of the greatest size more always fits
        step = max(1, 2 * step)
        found = best_fit(rest, low + step, bins_left)
    high, low = low + step, low + step // 2
    while found and low + 1 < high:
        half = (low + high) // 2
        tried = best_fit(rest, half, bins_left)
        if tried is None:
            low = half
        else:
            high, found = half, tried
    return [*range(alone), *[alone + b for b in found]]


def _measured(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, grp): the texts are read once, and not kept."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(own) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(own.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(own, 256)).alias("grp"))


def _items(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (grp, copies, item) and items (item, bytes), an item being a large
    group or a bundle of small ones."""
    groups = cut(docs.groupBy("grp").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    bundle: Column = F.pmod(F.xxhash64("grp"), F.lit(GRAIN)).cast("string")
    groups = groups.withColumn("item", F.when(F.col("bytes") * GRAIN > total, F.hex("grp")).otherwise(bundle))
    return groups, groups.groupBy("item").agg(F.sum("bytes").alias("bytes"))


def _placed(docs: DataFrame, groups: DataFrame, items: list, bins: list[int]) -> DataFrame:
    """``docs`` with their shard and a slot in it."""
    spark = docs.sparkSession
    where = spark.createDataFrame([(r["item"], b) for r, b in zip(items, bins, strict=True)], "item string, shard int")  # at most 2 * GRAIN rows
    n = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    found = groups.join(F.broadcast(where), "item").select("grp", "copies", "shard")
    out = by_key(docs, found, "grp", "copies", n, "inner").select("doc_id", "size", "text_crc32", "shard", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.col("grp"))).alias("key"))
    digits = max(1, math.ceil(math.log(max(1, n) / RANGE, 16)) + 1)
    out = cut(out.withColumn("range", F.substring("key", 1, digits)), "placed")
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = out.groupBy("shard", "range").agg(F.count("*").alias("rows")).select("shard", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "range").orderBy("key", "text_crc32")
    numbered = out.withColumn("nth", F.row_number().over(inside))
    return numbered.join(ranges, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))


def _packed(df: DataFrame, doc_id: str, text: str, way) -> DataFrame:
    docs = cut(_measured(df, doc_id, text), "measured")
    groups, sums = _items(docs)
    items = sorted(sums.collect(), key=lambda r: (-r["bytes"], r["item"]))  # at most 2 * GRAIN rows
    return _placed(docs, groups, items, way([r["bytes"] for r in items]))


def pack(df: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): as few shards of ``capacity``
    bytes as best fit decreasing finds."""
    return _packed(df, doc_id, text, lambda sizes: best_fit(sizes, capacity))


def shards(df: DataFrame, n: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): ``n`` shards of
    near equal bytes.  The law is ``bytes``, so ``grown_shard`` is null."""
    out = _packed(df, doc_id, text, lambda sizes: near_equal(sizes, n))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
