"""Exact vector queries: nearest, outliers, centroids, pairs of two documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.registry import query
from quillspark.sources.tables import table


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in double precision; null if either vector has no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def nearest_to(e: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` vectors nearest to the one vector (q) of ``query``, which is
    broadcast: ranked by the exact similarity, which is rounded in the end."""
    near = e.join(F.broadcast(query.select("q").limit(1))).withColumn("_s", cosine("v", "q"))
    return near.orderBy(F.desc("_s"), "vec_id").limit(k).select("vec_id", F.round("_s", 6).alias("similarity"))


def similar_to(e: DataFrame, vec_id: int, k: int = 10, same_label: bool = False) -> DataFrame:
    """The ``k`` nearest to a stored vector, itself excluded; among those of its
    label (its document) only, if so asked."""
    source = e.where(F.col("vec_id") == vec_id).select(F.col("v").alias("q"), F.col("label").alias("q_label")).limit(1)
    others = e.where(F.col("vec_id") != vec_id)
    return nearest_to(others.join(F.broadcast(source.select("q_label")), F.col("label") == F.col("q_label"), "left_semi") if same_label else others, source, k)


_SIMILAR = V + " SELECT v.vec_id, round(list_cosine_similarity(v.v, q.v), 6) AS similarity FROM v JOIN v q ON q.vec_id = 7 AND v.vec_id <> 7{more} ORDER BY list_cosine_similarity(v.v, q.v) DESC, vec_id LIMIT 10"


@query(_SIMILAR.format(more=""))
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return similar_to(vectors(spark, folder), 7)


@query(_SIMILAR.format(more=" AND v.label = q.label"))
def nearest_in_document(spark: SparkSession, folder: str) -> DataFrame:
    return similar_to(vectors(spark, folder), 7, same_label=True)


_ASKED = [1.0, -1.0, 0.5, 0.25] * 16  # what an encoder would make of a text


@query(f"{V}, q AS (SELECT {_ASKED}::DOUBLE[] AS q) SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM v, q ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 10")
def nearest_to_text(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors nearest to that of a text (from an encoder, here given)."""
    return nearest_to(vectors(spark, folder), spark.createDataFrame([(_ASKED,)], "q array<double>"))


def centroids(e: DataFrame) -> DataFrame:
    """(label, c): means by component."""
    p = e.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return p.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("c"))


C = f"{V}, p AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM v), c AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM p GROUP BY ALL) GROUP BY label)"


@query(f"{C} SELECT label, len(c)::INTEGER AS width, round(sqrt(list_inner_product(c, c)), 5) AS length FROM c")
def centroid_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return centroids(vectors(spark, folder)).select("label", F.size("c").alias("width"), F.round(F.sqrt(dot("c", "c")), 5).alias("length"))


@query(f"""{C}, s AS (SELECT v.label, v.vec_id, list_cosine_similarity(v.v, c.c) AS similarity FROM v JOIN c USING (label))
SELECT label, vec_id, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity, vec_id) <= 5""")
def outliers(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors of each label farthest from its centroid."""
    e = vectors(spark, folder)
    s = e.join(centroids(e), "label").select("label", "vec_id", cosine("v", "c").alias("similarity"))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("similarity", "vec_id"))).where("n <= 5")
    return s.select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


def _nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """For each vector of ``a`` its nearest of ``b``; sums in the order of the
    components, so that equal vectors are equally near."""
    x, y = np.stack(a["v"]), np.stack(b["v"])
    dots, nx, ny = np.zeros((len(x), len(y))), np.zeros(len(x)), np.zeros(len(y))
    for k in range(x.shape[1]):
        dots += x[:, k, None] * y[None, :, k]
        nx += x[:, k] ** 2
        ny += y[:, k] ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where((nx[:, None] > 0) & (ny > 0), dots / np.sqrt(nx[:, None] * ny), -np.inf)
    at = s.argmax(1)  # the first of equals
    near = pd.DataFrame({"a_id": a["vec_id"].to_numpy(), "b_id": b["vec_id"].to_numpy()[at], "s": s[np.arange(len(x)), at]})
    return near[np.isfinite(near["s"])]


def nearest_pairs(a: DataFrame, b: DataFrame, limit: int, block: int = 2048) -> DataFrame:
    """The ``limit`` most similar of the pairs that each vector of ``a`` makes
    with its nearest of ``b``.  Both sides are dealt to blocks of about ``block``
    vectors; a task compares a block of each and returns one row for each vector
    of ``a``, so no row or task grows with the tables.  Vectors are of one length."""
    blocks = lambda df: max(1, -(-df.count() // block))
    na, nb = blocks(a), blocks(b)
    dealt = lambda df, n: df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("own"))
    every = lambda df, n, own, other: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnRenamed("own", own)
    left, right = every(dealt(a, na), nb, "x", "y"), every(dealt(b, nb), na, "y", "x")

    def near(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _nearest(p, q.sort_values("vec_id")) if len(p) and len(q) else pd.DataFrame({"a_id": [], "b_id": [], "s": []})

    each = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(near, "a_id long, b_id long, s double")
    best = each.groupBy("a_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "b_id")).alias("m"))
    return best.orderBy("m.s", "a_id").limit(limit).select("a_id", "m.b_id", F.round(-F.col("m.s"), 6).alias("similarity"))


@query(f"""{V}, s AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_cosine_similarity(a.v, b.v) AS similarity FROM v a JOIN v b ON a.label = 1 AND b.label = 2),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) = 1)
SELECT a_id, b_id, round(similarity, 6) AS similarity FROM m ORDER BY m.similarity DESC, a_id LIMIT 20""")
def cross_document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    e = vectors(spark, folder)
    return nearest_pairs(e.where("label = 1"), e.where("label = 2"), 20)


@query("SELECT d.doc_id FROM documents d ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings) e USING (doc_id) WHERE trim(d.text) <> ''")
def missing_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are yet to be embedded; blank ones are not."""
    have = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, folder, "documents").where(F.trim("text") != "").join(have, "doc_id", "left_anti").select("doc_id")
