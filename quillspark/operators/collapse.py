"""Collapse of trees, level by level: each level reads the reduced rows of the
one below it.

A level is one grouping by parent and one join, so no task holds a tree, and the
rows of a level are written before the next one reads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.folders import written


def collapse(nodes: DataFrame, key: str, joint: str = " ", latest: Column | None = None) -> DataFrame:
    """Nodes (key, node, parent, depth, at, value, label) with what their
    subtrees come to: (key, node, depth, n_below, total, latest, joined).

    ``n_below``: nodes below; ``total``: sum of all values with the node's own;
    ``latest``: the value of the last node, by ``at``, that has one (or what the
    parameter makes of the value); ``joined``: labels of
    the leaves in their order.  Null values count nothing; a parent that does not
    exist has no row, and what is below it is not added up.
    """
    latest = F.col("value") if latest is None else latest
    depth = nodes.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for d in range(depth if depth is not None else -1, -1, -1):
        own = nodes.where(F.col("depth") == d)
        mine = F.when(latest.isNotNull(), F.struct("at", latest.alias("v")))
        if levels:
            part = F.struct("at", F.col("joined").alias("t"))
            below = levels[-1].groupBy(key, F.col("parent").alias("node")).agg(
                F.sum(F.col("n_below") + 1).alias("_n"), F.sum("total").alias("_total"), F.max("last").alias("_last"),
                F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.t), joint).alias("_joined"),
            )
            out = own.join(below, [key, "node"], "left")
        else:
            out = own.withColumn("_n", F.lit(None).cast("long")).withColumn("_total", F.lit(None).cast(nodes.schema["value"].dataType)).withColumn("_last", F.lit(None).cast(own.select(mine.alias("l")).schema["l"].dataType)).withColumn("_joined", F.lit(None).cast("string"))
        total = F.coalesce("value", F.lit(0)) + F.coalesce("_total", F.lit(0))
        out = out.select(key, "node", "parent", "depth", "at", F.coalesce("_n", F.lit(0)).cast("long").alias("n_below"), total.alias("total"), F.greatest(mine, "_last").alias("last"), F.when(F.col("_n").isNull(), F.col("label")).otherwise(F.col("_joined")).alias("joined"))
        levels.append(written(out, f"level-{d}"))
    if not levels:
        empty = nodes.select(key, "node", "depth", F.lit(0).cast("long").alias("n_below"), F.col("value").alias("total"), latest.alias("latest"), F.col("label").alias("joined"))
        return empty.where("false")
    return reduce(DataFrame.unionByName, levels).select(key, "node", "depth", "n_below", "total", F.col("last.v").alias("latest"), "joined")
