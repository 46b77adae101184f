"""Profiles of mentions: concentration, runs, clusters and stretches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concentration(mentions: DataFrame, key: str, author: str) -> DataFrame:
    """(key, hhi, top1, top3, leading): sum of squared shares, the largest
    share, the three largest, and whose they are."""
    n = mentions.groupBy(key, author).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), author))
    s = n.withColumn("share", share).withColumn("k", rank)
    top = F.when(F.col("k") <= 3, F.struct("k", F.col(author).alias("a")))
    return s.groupBy(key).agg(
        F.round(F.sum(F.col("share") * F.col("share")), 4).alias("hhi"), F.round(F.max("share"), 4).alias("top1"),
        F.round(F.sum(F.when(F.col("k") <= 3, F.col("share"))), 4).alias("top3"), F.array_join(F.transform(F.array_sort(F.collect_list(top)), lambda x: x.a), ",").alias("leading"),
    )


def dominant_author(mentions: DataFrame, unit: Sequence[str], author: str, offset: str) -> DataFrame:
    """(unit, n, dominant): mentions of each unit and the author first to reach the most."""
    per = mentions.groupBy(*unit, author).agg(F.count("*").alias("n"), F.max(offset).alias("reached"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "reached", F.col(author).alias("a")))
    return per.groupBy(*unit).agg(F.sum("n").alias("n"), best.getField("a").alias("dominant"))


def author_runs(rows: DataFrame, key: str, by: Sequence[str], author: str) -> DataFrame:
    """(key, author, first_n, len) of runs of rows with one author."""
    w = Window.partitionBy(key).orderBy(*by)
    p = rows.select(key, *by, F.col(author).alias("author")).withColumn("n", F.row_number().over(w).cast("long"))
    new = F.when(F.col("author").eqNullSafe(F.lag("author").over(w)) & (F.col("n") > 1), 0).otherwise(1)
    p = p.withColumn("_c", new).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(key, "run").agg(F.min("author").alias("author"), F.min("n").alias("first_n"), F.count("*").alias("len")).drop("run")


def stretches(runs: DataFrame, key: str, used: Column, least: int) -> DataFrame:
    """(key, first_n, last_n): maximal stretches outside the ``used`` runs."""
    w = Window.partitionBy(key).orderBy("first_n").rowsBetween(Window.unboundedPreceding, 0)
    free = runs.withColumn("_g", F.sum(used.cast("int")).over(w)).where(~used)
    out = free.groupBy(key, "_g").agg(F.min("first_n").alias("first_n"), (F.max(F.col("first_n") + F.col("len")) - 1).alias("last_n"))
    return out.where(F.col("last_n") - F.col("first_n") + 1 >= least).drop("_g")
