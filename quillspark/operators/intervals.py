"""Joins of points and ranges by position, within a key.

A range [start, end) belongs to the class of the least power of two that is not
below its length, and in that class to the one or two bins it touches; a point
looks into one bin of each class its key has.  So a range is two rows at most
however wide it is, a point a row for each class, and what meets in a bin lies
within two lengths of what matches.  Where only the fact counts (is a point in
any range?), ranges and points are swept in order instead, in bins of positions
whose running ends are handed on, so no task holds a whole key.

Empty, reversed and null ranges hold nothing; null positions and keys match
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _class(start: Column, end: Column) -> Column:
    """k: the least with 2^k >= length, from the digits of length - 1."""
    return F.when(end - start <= 1, 0).otherwise(F.length(F.bin(end - start - 1))).cast("int")


def _width(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _bin(at: Column, k: Column) -> Column:
    return F.call_function("shiftright", at, k)


def matches(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Each point with each range of its key that holds it: the columns of both
    (``key`` once)."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    r = ranges.where((e > s) & F.col(key).isNotNull()).withColumn("_class", _class(s, e))
    bins = F.sequence(_bin(s, F.col("_class")), _bin(e - 1, F.col("_class")))  # one or two
    r = r.withColumn("_bin", F.explode(bins))
    classes = r.select(key, "_class").distinct()
    p = points.where(F.col(at).isNotNull()).join(classes, key).withColumn("_bin", _bin(F.col(at).cast("long"), F.col("_class")))
    both = p.join(r, [key, "_class", "_bin"])
    return both.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_class", "_bin")


def overlapping(left: DataFrame, right: DataFrame, key: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Each range of ``left`` with each of ``right`` it overlaps: either the left
    one begins in the right one, or the right one begins later and in the left."""
    a = matches(left.where(F.col(first[1]) > F.col(first[0])), right, key, first[0], *second)
    b = matches(right.where(F.col(second[1]) > F.col(second[0])), left, key, second[0], *first).where(F.col(second[0]) > F.col(first[0]))
    return a.unionByName(b)


def covered(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """``points`` with the column ``covered``: does any range of its key hold it?

    A sweep: the greatest end of the ranges that begin up to a point tells.  The
    ends run within bins of ``width`` positions, and each bin starts with the
    greatest end of those before it.
    """
    columns = points.columns
    hold = F.struct(*[F.col(f"`{c}`") for c in columns])
    p = points.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.lit(None).cast("long").alias("_end"), hold.alias("_row"))
    r = ranges.where((F.col(end) > F.col(start)) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(start).cast("long").alias("_at"), F.col(end).cast("long").alias("_end"))
    r = r.groupBy("_key", "_at").agg(F.max("_end").alias("_end")).withColumn("_row", F.lit(None).cast(p.schema["_row"].dataType))
    both = p.unionByName(r).withColumn("_bin", F.floor(F.col("_at") / width).cast("long"))
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    handed = both.where("_end is not null").groupBy("_key", "_bin").agg(F.max("_end").alias("_most"))
    bins = both.select("_key", "_bin").distinct().join(handed, ["_key", "_bin"], "left").select("_key", "_bin", F.max("_most").over(before).alias("_before"))
    run = Window.partitionBy("_key", "_bin").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_reach", F.max("_end").over(run)).where("_row is not null")
    out = swept.join(bins, ["_key", "_bin"], "left")
    inside = F.coalesce(F.greatest("_reach", "_before") > F.col("_at"), F.lit(False))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], inside.alias("covered"))


def delete_covered(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """``points`` that no range holds."""
    return covered(points, ranges, key, at, start, end).where("not covered").drop("covered")


def delete_referring(rows: DataFrame, row_key: Sequence[str], ranges: str, item: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """``rows``, known by ``row_key``, without those whose array ``ranges`` refers, in
    the field ``item``, to a ``gone_key`` of ``gone``: EXISTS over an exploded array."""
    refs = rows.select(*row_key, F.explode(ranges).alias("_r")).select(*row_key, F.col(f"_r.{item}").alias(gone_key))
    hit = refs.join(gone.select(gone_key).distinct(), gone_key, "left_semi").select(*row_key).distinct()
    return rows.join(hit, list(row_key), "left_anti")
