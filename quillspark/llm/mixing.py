"""Mixing sources to target weights, exact to the word.

Every document gets a hash-random key, of its id and text.  The texts are read
once, for their sizes.  Within its source the documents are dealt to key ranges
(the leading digits of the key, more of them the more rows there are), the
ranges are summed and prefix-summed, and a window inside each range adds the
offset of the ranges before it: a distributed prefix sum of word counts in which
no task holds more than one range of one source.  A source whose budget exceeds its
size goes through whole epochs first; the last, partial epoch is cut at the
exact budget, so the document at the cut gives a part of its words.

Rows: a null or empty text has size 0 and gives nothing; a null source is a
source of its own, last in the order of the weights; rows without an id, or of
one id and other texts, have keys of their own; a repeated row counts as often
as it stands (which of equal rows is cut makes no difference); further columns
are not read, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: Rows of a key range, about, if one source had them all.
RANGE = 1 << 16


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, null as 0."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size), by weight, each at most
    ``most`` times its size; what is above goes to the others by weight until
    none is above.  In the order of size per weight a source is capped exactly
    if its share of what the sources before it leave exceeds its cap, so one
    pass over the sources (a short table of totals) settles all rounds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("ratio", F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("capped", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("rest", share * F.col("all") - F.col("capped"))
    s = s.withColumn("full", F.col("rest") * F.col("weight") >= most * F.col("source_size") * F.col("left_weight"))
    s = s.withColumn("rest_each", F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "rest", "left_weight"))).over(Window.partitionBy()))
    target = F.when(F.col("full"), most * F.col("source_size")).otherwise(F.col("rest_each.rest") * F.col("weight") / F.col("rest_each.left_weight"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source, source_size, target, epochs, taken) for each row of ``df``.

    ``epochs``: whole passes over the document; ``taken``: words of the mix
    that are its, ``epochs * size`` and what the partial epoch takes.
    """
    own = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), own))
    docs = cut(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), key.alias("key")), "sizes")
    digits = max(3, math.ceil(math.log(max(1, docs.count()) / RANGE, 16)) + 1)
    docs = docs.withColumn("bin", F.substring("key", 1, digits))
    bins = docs.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share)
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
    budgets = bins.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bin", "b.before", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = docs.where("size > 0").withColumn("upto", F.sum("size").over(inside)).unionByName(docs.where("size = 0").withColumn("upto", F.lit(0).cast("long"))).alias("d")
    out = run.join(budgets.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bin") == F.col("b.bin")))
    budget = F.floor(F.col("target")).cast("long")
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - (F.col("before") + F.col("upto") - F.col("size"))
    part = F.least(F.col("size"), F.greatest(left, F.lit(0)))
    return out.select("d.doc_id", "d.size", "d.source", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size") + part).cast("long").alias("taken"))


#: DuckDB's rows for :func:`mix` over ``documents``.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
w AS (
  SELECT *, ([3, 1, 2])[(rank - 1) % 3 + 1] AS weight, source_size / ([3, 1, 2])[(rank - 1) % 3 + 1] AS ratio, sum(source_size) OVER () AS total FROM s),
c AS (
  SELECT *, 1.5::DOUBLE * total - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM w),
f AS (SELECT *, rest * weight >= 2.0::DOUBLE * source_size * left_weight AS full_up FROM c),
o AS (SELECT rest, left_weight FROM f WHERE NOT full_up ORDER BY ratio, rank LIMIT 1),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN full_up THEN 2.0::DOUBLE * source_size ELSE o.rest * weight / o.left_weight::DOUBLE END AS target
  FROM f LEFT JOIN o ON true),
r AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before FROM d),
e AS (
  SELECT r.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target, epochs,
       (epochs * size + least(size, greatest(budget - epochs * source_size - before, 0)))::BIGINT AS taken
FROM e
"""
