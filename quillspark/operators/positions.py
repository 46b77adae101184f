"""Operators on ordered elements: as-of matches, islands, numbering, units.

All windows are partitioned by document; the sort they share is done once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order(key: str = "document_id", by: str = "char_start"):
    return Window.partitionBy(key).orderBy(by)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def after(w):
    return w.rowsBetween(1, Window.unboundedFollowing)


def is_heading() -> Column:
    return F.col("element_type") == "heading"


def n_chars() -> Column:
    """Length of an element, which needs no text."""
    return F.col("char_end") - F.col("char_start")


def nearest_heading(e: DataFrame, only: str | None = None) -> DataFrame:
    """Paragraphs with the start and type of the nearest typed heading before
    them.  With ``only`` headings of other types are not seen at all (filter
    before the match); without it the caller filters after the match."""
    seen = is_heading() & (F.col("function_type").isNotNull() if only is None else F.col("function_type") == only)
    at = F.last(F.when(seen, F.struct("char_start", "function_type")), ignorenulls=True).over(upto(order()))
    out = e.withColumn("h", at).where(~is_heading() & F.col("h").isNotNull())
    return out.withColumn("heading_start", F.col("h.char_start")).withColumn("heading_type", F.col("h.function_type")).drop("h")


def dual_heading(e: DataFrame) -> DataFrame:
    """Paragraphs with their direct heading and with the nearest typed one."""
    w = upto(order())
    out = e.withColumn("direct_start", F.last(F.when(is_heading(), F.col("char_start")), ignorenulls=True).over(w))
    out = out.withColumn("container_type", F.last(F.when(is_heading(), F.col("function_type")), ignorenulls=True).over(w))
    return out.where(~is_heading())


def next_heading(e: DataFrame) -> DataFrame:
    """Headings with the start of the next one, or the end of the document."""
    end = F.max("char_end").over(Window.partitionBy("document_id"))
    return e.withColumn("text_end", end).where(is_heading()).withColumn("next_start", F.coalesce(F.lead("char_start").over(order()), F.col("text_end")))


def blocks(e: DataFrame) -> DataFrame:
    """Every element with its block: the number of headings up to it."""
    return e.withColumn("block", F.sum(is_heading().cast("long")).over(upto(order())))


def runs(df: DataFrame, key: str, by: str, value: Column) -> DataFrame:
    """Islands of equal ``value``: adds ``run``, a number that grows where the
    value differs from the one before (null equals null)."""
    w = Window.partitionBy(key).orderBy(by)
    change = F.when(F.row_number().over(w) == 1, 1).when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(upto(w))).drop("_c")


def _folded(rows: DataFrame, start, step, add: str, kind: pa.DataType) -> DataFrame:
    """``rows``, which hold whole documents in order, with the column ``add``: what
    ``step(state, row)`` returns, the state beginning anew with each document.
    A task goes through its rows once; nothing but the state is kept."""
    src = rows.select(F.struct("*").alias("row"))
    schema = T.StructType([src.schema["row"], T.StructField("_new", T.StringType() if kind == pa.string() else T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, state = object(), None
        for b in batches:
            out, row = [], b.column(0)
            names = [row.type.field(k).name for k in range(row.type.num_fields)]
            columns = {c: row.field(names.index(c)).to_pylist() for c in ("document_id", "char_start", "level", *(x for x in ("_counted",) if x in names))}
            for k, own in enumerate(columns["document_id"]):
                if own != document:
                    document, state = own, start()
                out.append(step(state, {c: v[k] for c, v in columns.items()}))
            yield pa.record_batch([row, pa.array(out, kind)], names=["row", "_new"])

    return src.mapInArrow(run, schema).select("row.*", F.col("_new").alias(add))


def numbering(e: DataFrame) -> DataFrame:
    """Headings with their outline number, to any depth: at each level the count
    of headings since the last one of a smaller level; skipped levels read 0.
    Headings that are ``excluded`` (a column that may be there) and those without
    a level have none and count for nothing.

    The counters go along the headings of a document, in its order.
    """
    counted = ~F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in e.columns else F.lit(True)
    rows = e.where(is_heading()).withColumn("_counted", counted & F.col("level").isNotNull()).repartition("document_id").sortWithinPartitions("document_id", "char_start")

    def step(now: list[int], h: dict) -> str | None:
        if not h["_counted"]:
            return None
        now.extend([0] * (h["level"] - len(now)))
        now[h["level"] - 1] += 1
        del now[h["level"] :]
        return ".".join(map(str, now))

    return _folded(rows, list, step, "numbering", pa.string()).drop("_counted")


def unit_ends(e: DataFrame) -> DataFrame:
    """Headings with the start of the next heading of the same or a smaller
    level, or the end of the document, to any depth; a heading without a level
    ends with the document and ends no other.

    Going backwards the open headings are a stack, of which those above the level
    of the heading at hand go: each comes and goes once.
    """
    end = F.max("char_end").over(Window.partitionBy("document_id"))
    rows = e.withColumn("text_end", end).where(is_heading()).sortWithinPartitions("document_id", F.desc("char_start"))  # the window keeps documents together

    def step(above: list[tuple[int, int]], h: dict) -> int | None:
        if h["level"] is None:
            return None
        while above and above[-1][0] > h["level"]:
            above.pop()
        ended = above[-1][1] if above else None
        above.append((h["level"], h["char_start"]))
        return ended

    out = _folded(rows, list, step, "_ended", pa.int64())
    return out.withColumn("unit_end", F.coalesce("_ended", "text_end")).drop("_ended")


def complexes(e: DataFrame) -> DataFrame:
    """Runs of paragraphs under one direct heading; one without a container
    type closes the run, so a heading can give two complexes."""
    p = dual_heading(e)
    p = runs(p, "document_id", "char_start", F.struct("direct_start", F.col("container_type").isNotNull().alias("t")))
    p = p.where(F.col("container_type").isNotNull())
    return p.groupBy("document_id", "run").agg(F.min("direct_start").alias("heading_start"), F.min("container_type").alias("container_type"), F.count("*").alias("n_paragraphs"), F.min("char_start").alias("first_start"))


def reanchor(anchors: DataFrame, headings: DataFrame, within: int = 200) -> DataFrame:
    """Anchors (document_id, anchor_id, label, anchor_start) bound to headings
    (document_id, label, char_start): the exact place, else the first (not the
    nearest) of that label within the tolerance."""
    near = anchors.join(headings, ["document_id", "label"]).where(F.abs(F.col("char_start") - F.col("anchor_start")) <= within)
    best = near.groupBy("document_id", "anchor_id").agg(F.min(F.struct((F.col("char_start") != F.col("anchor_start")).alias("moved"), "char_start")).alias("b"))
    return anchors.join(best, ["document_id", "anchor_id"], "left").select("document_id", "anchor_id", "anchor_start", F.col("b.char_start").alias("bound_start"))
