"""Quality selection by importance resampling of hashed n-grams.

Two bags of tokens (words and runs of punctuation) and token pairs, hashed to
``SLOTS`` slots, are counted: one of the target texts (rows labelled of good
quality; all of them, or about ``sample``) and one of all texts.  A document's
log weight is the sum over its n-grams of log target probability minus log raw
probability.  A Gumbel variate drawn from the hash of the row is added, and the
k largest keys are the sample (without replacement, by weight).

Counting is a partial sum in every task (a fixed table of counts); the cut at
rank k is found by refining a histogram of the keys, so no task sorts all rows.

Rows: a null or empty text has log weight 0; rows without an id, or of one id
and other texts, have variates of their own, rows equal in both share one, and
of those at the cut any are taken; without target rows all weights are 0 and
the sample is uniform; further columns are not read, whatever they are called;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common as c

SLOTS = 10_000


def _marks() -> c.Alphabet:
    """Runs of ASCII punctuation are tokens too."""
    inside = np.zeros(256, bool)
    inside[33:127] = True
    inside[48:58] = inside[65:91] = inside[97:123] = False
    return c.Alphabet(inside, None)


def _slots(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of every word or mark and every pair of neighbours."""
    words, marks = c.tokens(data, at, c.folded()), c.tokens(data, at, _marks())
    order = np.argsort(np.concatenate([words.start, marks.start]), kind="stable")
    merged = [np.concatenate(x)[order] for x in ((words.hashes, marks.hashes), (words.start, marks.start), (words.end, marks.end))]
    t = c.Tokens(*merged, words.first + marks.first)
    of = t.text_of()
    pair = t.whole(2, of)
    h = np.concatenate([t.hashes, c.grams(t.hashes, 2)[pair]])
    return np.concatenate([of, of[: len(pair)][pair]]), (h % c.U(SLOTS)).astype(np.int64)


def log_ratios(docs: DataFrame, target: DataFrame, sample: int | None = 50_000) -> np.ndarray:
    """Log target minus log raw probability of each slot; docs (key, text),
    target (key).  The raw model counts all documents, the target model those
    of the target, or about ``sample`` of them chosen by the hash of their ids
    (whose ids are broadcast; without ``sample`` they are joined)."""
    ids = target.where("key is not null").distinct()
    if sample is None:
        docs = docs.join(ids.withColumn("good", F.lit(True)), "key", "left").withColumn("good", F.coalesce("good", F.lit(False)))
        held = None
    else:
        share = min(1.0, sample / max(1, ids.count()))
        few = ids.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))).toArrow()
        held = docs.sparkSession.sparkContext.broadcast(np.sort(np.asarray(few["key"])))  # about ``sample`` ids
        docs = docs.withColumn("good", F.lit(False))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            if held is None:
                good = b.column("good").to_numpy(zero_copy_only=False)
            else:
                key = np.asarray(b.column("key").fill_null(-1))
                spot = np.minimum(np.searchsorted(held.value, key), max(0, len(held.value) - 1))
                good = (held.value[spot] == key if len(held.value) else np.zeros(len(key), bool)) & b.column("key").is_valid().to_numpy(zero_copy_only=False)
            for i, _, data, at in c.slices(b.column("text")):
                of, slot = _slots(data, at)
                total[0] += np.bincount(slot, minlength=SLOTS)
                total[1] += np.bincount(slot[good[i + of]], minlength=SLOTS)
        yield pa.record_batch([pa.array(np.arange(2 * SLOTS)), pa.array(total.ravel())], names=["cell", "n"])

    rows = docs.select("key", "text", "good").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 2 * SLOTS rows
    n = np.zeros(2 * SLOTS)
    for r in rows:
        n[r["cell"]] = r["n"]
    raw, good = n[:SLOTS] + 1, n[SLOTS:] + 1
    return np.zeros(SLOTS) if not n[SLOTS:].sum() else np.log(good / good.sum()) - np.log(raw / raw.sum())


def kth_largest(rows: DataFrame, column: str, k: int, room: int = 4096) -> float | int:
    """The ``k``-th largest value of ``column``, by histograms of 1,024 bins that
    are refined until at most ``room`` rows, or equal ones, are left."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    inside = rows
    while low < high:
        step = (high - low) / 1024
        spot = F.least(F.lit(1023), F.floor((F.col(column) - F.lit(low)) / F.lit(step))).cast("int")
        bins = {r["b"]: r for r in inside.groupBy(spot.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(bins, reverse=True):
            if bins[b]["n"] >= k:
                break
            k -= bins[b]["n"]
        found = bins[b]
        inside = inside.where(F.col(column).between(found["low"], found["high"]))
        if found["n"] <= room:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]
        low, high = found["low"], found["high"]
    return low


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.85, sample: int | None = 50_000, seed: str = "gumbel") -> DataFrame:
    """(doc_id, log_weight, key_value, kept) of each row of ``df``: ``kept`` holds
    for the ``round(share * rows)`` largest keys.  ``target``: ids (doc_id) of
    target rows."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ratio = spark.sparkContext.broadcast(log_ratios(docs, target.select(F.col("doc_id").cast("long").alias("key")), sample))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(0)]
            for _, _, data, at in c.slices(b.column("text")):
                of, slot = _slots(data, at)
                out.append(np.bincount(of, ratio.value[slot], len(at) - 1))
            yield pa.record_batch([b.column("key"), b.column("uniform"), pa.array(np.concatenate(out))], names=["key", "uniform", "log_weight"])

    uniform = (F.pmod(F.xxhash64(F.lit(seed), "key", F.coalesce("text", F.lit(""))), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    weighed = docs.withColumn("uniform", uniform).mapInArrow(weigh, "key long, uniform double, log_weight double")
    scored = weighed.select("key", "log_weight", (F.col("log_weight") - F.log(-F.log("uniform"))).alias("key_value"), F.monotonically_increasing_id().alias("row"))
    scored = c.cut(scored, "weights")  # the numbers of rows are fixed by being written
    k = round(share * scored.count())
    kept = F.lit(False)
    if k:
        edge = kth_largest(scored, "key_value", k)
        left = k - scored.where(F.col("key_value") > edge).count()
        tied = scored.where(F.col("key_value") == edge)
        last = kth_largest(tied, "row", left)
        kept = (F.col("key_value") > edge) | (F.col("key_value") == edge) & (F.col("row") >= last)
    return scored.select(F.col("key").alias("doc_id"), "log_weight", "key_value", kept.alias("kept"))
