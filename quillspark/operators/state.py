"""State kept as logs: latest values, memberships, upserts, version stacks.

The changes of a row-oriented store are written here as rewrites of tables:
a keyed fold or join gives the new table, to be written in place of the old.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import json_values


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str], *columns: str) -> DataFrame:
    """Latest non-null value of each column; a partial aggregate, no sort."""
    at = F.struct(*by)
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).getField("v").alias(c) for c in columns])


def members(df: DataFrame, keys: Sequence[str], by: Sequence[str], assign: Column, remove: Column) -> DataFrame:
    """Keys whose last assigning or removing event assigns."""
    last = df.where(assign | remove).groupBy(*keys).agg(F.max(F.struct(*by, assign.alias("in"))).alias("l"))
    return last.where("l.in").select(*keys)


def newest(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order ``by`` (last writer wins)."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Column | None = None, merged: Sequence[str] = ()) -> DataFrame:
    """``old`` with rows of ``new`` written over it column by column where they
    are not null; ``keep`` (over columns of old) protects rows from change, and
    JSON values of the columns ``merged`` are merged with those they meet.
    Adds ``outcome``: created, updated, skipped or unchanged."""
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    j = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), same, "full_outer")
    there, asked = F.col("o._o").isNotNull(), F.col("n._n").isNotNull()
    held = there & F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    new_value = lambda c: F.coalesce(json_values.merge(F.col(f"o.{c}"), F.col(f"n.{c}")), f"n.{c}", f"o.{c}") if c in merged else F.coalesce(f"n.{c}", f"o.{c}")
    values = [F.when(held, F.col(f"o.{c}")).otherwise(new_value(c)).alias(c) for c in old.columns]
    outcome = F.when(~there, "created").when(~asked, "unchanged").when(held, "skipped").otherwise("updated")
    return j.select(*values, outcome.alias("outcome"))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks (conflicts do nothing)."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def merge_entities(links: DataFrame, mapping: DataFrame, left: str, right: str) -> DataFrame:
    """Links with merged ends replaced by their survivor, without loops and
    duplicates.  ``mapping``: (merged, survivor)."""
    m, columns = mapping.select("merged", "survivor"), links.columns
    for end in (left, right):
        links = links.join(m.withColumnRenamed("merged", end), end, "left").withColumn(end, F.coalesce("survivor", end)).drop("survivor")
    return links.where(F.col(left) != F.col(right)).select(*columns).distinct()


def version_stack(entries: DataFrame, key: str, by: Sequence[str], anchors: str, snapshot: str, kind: str = "kind") -> DataFrame:
    """A stack for each key from its entries in order: an entry of kind
    ``re_spec`` replaces an earlier one of the same set of anchors; the current
    snapshot is that of the last ``re_spec``, else of the origin."""
    e = entries.withColumn("_set", F.when(F.col(kind) == "re_spec", F.array_join(F.array_sort(F.array_distinct(anchors)), "|")).otherwise("origin"))
    last = e.groupBy(key, "_set").agg(F.max(F.struct(*by, F.col(kind).alias("kind"), F.col(snapshot).alias("snapshot"))).alias("l"))
    top = F.max(F.when(F.col("l.kind") == "re_spec", F.col("l")))
    origin = F.max(F.when(F.col("l.kind") != "re_spec", F.col("l")))
    return last.groupBy(key).agg(F.count("*").alias("depth"), F.coalesce(top.getField("snapshot"), origin.getField("snapshot")).alias("current"))
