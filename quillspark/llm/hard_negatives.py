"""Hard negatives by norm-bucketed search.

Components become whole numbers, and the score of a row is its inner product
with the anchor, which by Cauchy-Schwarz is at most the product of both norms.
Candidates are sorted by their norm, the longest first, and cut to buckets of at
most ``BUCKET`` rows, each with its greatest norm.  Anchors are dealt to blocks,
buckets to spans of ``SPAN``; a task takes a block and a span, and goes through the
buckets from the longest on.  For each window (the best rows of the anchor's own
label, or the scores that a positive allows) a bucket is skipped where its bound
is below the window's lower limit or below the ``k``-th score found so far; the
first span, of the longest candidates, is searched before the others, and its ``k``-th
scores hold for all.  Skipped rows cannot be among the results, so these
are exact.

Positives are searched first, over buckets of all rows; then the windows of
negatives, which depend on the positives' scores.

Rows: those with a null label or vector or a null or non-finite component take
no part; vectors of one length are compared with each other only; a row
repeated as a whole counts once, rows of one id with other vectors or labels are rows
of their own; rows without an id are candidates, after others of their score,
but no anchors; scores beyond 64 bits read as the greatest or least such number;
further columns are not read, whatever they are called; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import common as c

SCALE = 256
BUCKET = 4096  # candidates that are scored at once
SPAN = 4  # buckets of a task
BLOCK = 2048  # anchors of a task, about
EXACT = float(1 << 52)  # up to here products of doubles are whole

#: A row, known by (key, tie); ``x`` are its components, as int16 if they fit, else as doubles.
ROW = "d int, key long, tie long, label string, size double, x binary"


def rows(df: DataFrame, vec_id: str, embedding: str, label: str, shift: int | None) -> DataFrame:
    """The rows that take part, each once.  Where the id is divisible by
    ``shift``, the label first becomes (label + 1) % 10."""
    v = F.col(embedding).cast("array<double>")
    src = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v")).where("label is not null and v is not null")
    if shift:
        src = src.withColumn("label", F.when(F.col("id") % shift == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    src = src.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    src = src.select(F.coalesce("id", F.lit(c.NO_ID)).alias("key"), F.col("label").cast("string").alias("label"), "v").distinct().withColumn("tie", F.xxhash64("v", "label"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, blobs, long = [], [], []
            for x in b.column("v"):
                y = np.clip(np.floor(SCALE * np.asarray(x.values, np.float64)), -1e300, 1e300)
                long.append(len(y))
                blobs.append((y.astype(np.int16) if np.abs(y).max(initial=0) < 1 << 15 else y).tobytes())
                sizes.append(float((y * y).sum()))
            kinds = (pa.int32(), pa.float64(), pa.binary())
            d, size, x = (pa.array(col, t) for col, t in zip((long, sizes, blobs), kinds, strict=True))
            yield pa.record_batch([d, b.column("key"), b.column("tie"), b.column("label"), size, x], names=["d", "key", "tie", "label", "size", "x"])

    return src.select("key", "tie", "label", "v").mapInArrow(whole, ROW)


def _matrix(blobs: list[bytes], d: int) -> np.ndarray:
    """Components as doubles, a row for each blob."""
    if all(len(x) == 2 * d for x in blobs):
        return np.frombuffer(b"".join(blobs), np.int16).reshape(len(blobs), d).astype(np.float64)
    return np.stack([np.frombuffer(x, np.int16 if len(x) == 2 * d else np.float64).astype(np.float64) for x in blobs])


BUCKETS = "d int, span int, bucket long, most double, n int, keys binary, ties binary, labels array<string>, x array<binary>"


def buckets(found: DataFrame, spans: int) -> DataFrame:
    """Candidates by falling norm, packed to rows of at most ``BUCKET``."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, {}
        for f in frames:
            held = f if held is None else pd.concat([held, f])
            while held is not None and len(held):
                d = held["d"].iloc[0]
                run = held["d"].to_numpy() == d
                n = len(run) if run.all() else int(run.argmin())
                if n == len(held) and n < BUCKET:
                    break  # more of it may follow
                yield _bucket(held.iloc[: min(n, BUCKET)], at)
                held = held.iloc[min(n, BUCKET) :]
        if held is not None and len(held):
            yield _bucket(held, at)

    def _bucket(f: pd.DataFrame, at: dict) -> pd.DataFrame:
        f = f.sort_values(["key", "tie"])
        d, part = int(f["d"].iloc[0]), int(f["part"].iloc[0])
        k = at[d] = at.get(d, -1) + 1
        blob = [c.pack(f[x].to_numpy()) for x in ("key", "tie")]
        row = (d, (part << 12) + k // SPAN, (part << 32) + k, float(f["size"].max()), len(f), *blob, f["label"].tolist(), f["x"].tolist())
        return pd.DataFrame([row], columns=[x.split()[0] for x in BUCKETS.split(", ")])

    dealt = found.repartitionByRange(spans, F.col("d"), F.col("size").desc(), F.col("key"), F.col("tie")).withColumn("part", F.spark_partition_id())
    return dealt.sortWithinPartitions("d", F.col("size").desc(), "key", "tie").mapInPandas(packed, BUCKETS)


def _product(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole rows; ``bound`` is what none exceeds."""
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    if not a.size:
        return np.zeros((len(a), len(b)), np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


WINDOWS = "d int, block int, anchor long, anchor_tie long, positive long, positive_tie long, low long, high long, least long, label string, size double, x binary"
FOUND = "anchor long, anchor_tie long, positive long, positive_tie long, low long, key long, tie long, score long"


def _look(frame: pd.DataFrame, asked: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """The ``k`` best of each window among some buckets, the longest first."""
    asked = asked.sort_values(["anchor", "anchor_tie", "positive", "positive_tie"], kind="stable")
    d = int(asked["d"].iloc[0])
    own, first = np.unique(np.stack([asked["anchor"], asked["anchor_tie"]], 1), axis=0, return_index=True)
    of = np.searchsorted(first, np.arange(len(asked)), "right") - 1
    a = _matrix(list(asked["x"].iloc[first]), d)
    long, label = asked["size"].to_numpy()[first], asked["label"].to_numpy()[first]
    low, high, least = (asked[x].to_numpy().copy() for x in ("low", "high", "least"))
    best: list[list[tuple]] = [[] for _ in range(len(asked))]
    for row in frame.sort_values(["most", "bucket"], ascending=[False, True]).itertuples():
        bound = np.sqrt(long * row.most) * (1 + 1e-9)  # the norms are rounded
        need = np.maximum(low, least)
        todo = np.flatnonzero(bound[of] >= need)
        if not len(todo):
            continue
        who = np.unique(of[todo])
        key, tie = c.unpack(row.keys, row.n, np.int64)[0], c.unpack(row.ties, row.n, np.int64)[0]
        score = _product(a[who], _matrix(list(row.x), d), float(bound[who].max()))
        alike = np.asarray(row.labels, object)[None, :] == label[who][:, None]
        fits = alike & ~((key[None, :] == own[who, :1]) & (tie[None, :] == own[who, 1:])) if same else ~alike
        spot = np.searchsorted(who, of[todo])
        for w, i in zip(todo, spot, strict=True):
            some = np.flatnonzero(fits[i] & (score[i] >= need[w]) & (score[i] <= high[w]))
            if not len(some):
                continue
            if len(some) > k:  # keys ascend, so equal scores stay in their order
                some = some[np.argsort(-score[i][some], kind="stable")[:k]]
            best[w] = sorted(best[w] + [(-int(score[i][j]), int(key[j]), int(tie[j])) for j in some])[:k]
            if len(best[w]) == k:
                least[w] = max(least[w], -best[w][-1][0])
    back = asked[["anchor", "anchor_tie", "positive", "positive_tie", "low"]].to_numpy()
    out = [(*back[w], key, tie, -s) for w, some in enumerate(best) for s, key, tie in some]
    return pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])


def _search(packed: DataFrame, windows: DataFrame, same: bool, k: int, tasks: int) -> DataFrame:
    """The ``k`` best rows of each window, over all spans."""
    spans = packed.groupBy("d", "span").agg(F.max("most").alias("most"))
    ahead = spans.groupBy("d").agg(F.max(F.struct("most", F.negate("span").alias("s"))).alias("m")).select("d", F.negate("m.s").alias("span"))
    ids = ["anchor", "anchor_tie", "positive", "positive_tie"]

    def look(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _look(x, y, same, k) if len(x) and len(y) else pd.DataFrame({n.split()[0]: [] for n in FOUND.split(", ")})

    def visit(which: DataFrame, asked: DataFrame) -> DataFrame:
        """Each block against each of the spans that may reach a window of it."""
        blocks = asked.groupBy("d", "block").agg(F.max(F.col("size")).alias("size"), F.min(F.greatest("low", "least")).alias("need"))
        pairs = which.join(blocks, "d").where(F.sqrt(F.col("size")) * F.sqrt("most") * (1 + 1e-9) >= F.col("need")).select("d", "span", "block")
        pairs = c.cut(pairs, "pairs")
        left = packed.join(pairs, ["d", "span"]).repartition(tasks, "d", "span", "block")
        right = asked.join(pairs, ["d", "block"]).repartition(tasks, "d", "span", "block")
        keys = ["d", "span", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(look, FOUND)

    def best(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*ids).orderBy(F.desc("score"), "key", "tie")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    head = c.cut(best(visit(spans.join(ahead, ["d", "span"]), windows)), "head")
    kth = head.where(F.col("rank") == k).select(*ids, F.col("score").alias("kth"))
    told = windows.join(kth, ids, "left").withColumn("least", F.greatest("least", F.coalesce("kth", F.col("least")))).select(windows.columns)
    rest = visit(spans.join(ahead, ["d", "span"], "left_anti"), c.cut(told, "told"))
    return best(head.drop("rank").unionByName(rest))


def mine(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 100, shift: int | None = 7, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score):
    for each anchor (an id divisible by ``every``) and each of its best
    ``positives`` the ``k`` best rows of other labels with a score from ``low`` to
    ``high`` hundredths of the positive's."""
    spark = df.sparkSession
    found = c.cut(rows(df, vec_id, embedding, label, shift), "rows")
    n = found.count()
    tasks = 2 * c.partitions(spark)
    packed = c.cut(buckets(found, max(c.partitions(spark), -(-n // (BUCKET * SPAN)))), "buckets")
    least = F.lit(-(1 << 63)).cast("long")
    most = F.lit((1 << 63) - 1).cast("long")
    anchors = found.where((F.col("key") % every == 0) & (F.col("key") != c.NO_ID))
    blocks = F.pmod(F.xxhash64("key", "tie"), F.lit(max(1, -(-n // every // BLOCK)))).cast("int")
    anchors = c.cut(anchors.withColumn("block", blocks), "anchors")
    none = F.lit(None).cast("long")
    first = anchors.select("d", "block", F.col("key").alias("anchor"), F.col("tie").alias("anchor_tie"), F.lit(0).cast("long").alias("positive"), F.lit(0).cast("long").alias("positive_tie"), least.alias("low"), most.alias("high"), least.alias("least"), "label", "size", "x")
    good = _search(packed, first, True, positives, tasks).select("anchor", "anchor_tie", F.col("key").alias("positive"), F.col("tie").alias("positive_tie"), F.col("score").alias("positive_score"))
    good = c.cut(good.where("positive_score >= 0"), "positives")  # below 0 the limits cross
    wide = F.col("positive_score").cast("decimal(38,0)")
    lowest = F.ceil(wide * low / 100).cast("long")
    highest = F.floor(wide * high / 100).cast("long")
    windows = good.join(anchors.select("d", "block", F.col("key").alias("anchor"), F.col("tie").alias("anchor_tie"), "label", "size", "x"), ["anchor", "anchor_tie"])
    windows = windows.select("d", "block", "anchor", "anchor_tie", "positive", "positive_tie", lowest.alias("low"), highest.alias("high"), least.alias("least"), "label", "size", "x")
    out = _search(packed, c.cut(windows, "windows"), False, k, tasks)
    out = out.select("anchor", "anchor_tie", "positive", "positive_tie", "rank", "key", F.col("score").alias("negative_score"))
    named = out.join(good, ["anchor", "anchor_tie", "positive", "positive_tie"])
    ids = lambda x: F.nullif(F.col(x), F.lit(c.NO_ID))
    return named.select(F.col("anchor").alias("anchor_id"), ids("positive").alias("positive_id"), "rank", ids("key").alias("negative_id"), "positive_score", "negative_score")


#: DuckDB's rows for :func:`mine` over ``embeddings``.
SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
p AS (
  SELECT a.vec_id AS anchor_id, a.label, a.v, b.vec_id AS positive_id, list_inner_product(a.v, b.v)::BIGINT AS positive_score
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, b.vec_id) <= 5),
n AS (SELECT p.*, e.vec_id AS negative_id, list_inner_product(p.v, e.v)::BIGINT AS negative_score FROM p JOIN e ON p.label <> e.label)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score QUALIFY rank <= 10
"""
