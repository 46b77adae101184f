"""Rows that a parser can't read, set aside with their reason and tried again.

Each run reads what is new and what failed before with attempts left.  A parser
works on one row; what it raises is that row's reason, and the others go on.  The
run's good rows, bad rows and keys are written to a folder of its own; a run that
died half way is not marked as ended, is not read, and is done again as a whole.
So good rows arrive once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.folders import scratch


def tried(df: DataFrame, key: str, column: str, parse: Callable[[object], object], result: str) -> DataFrame:
    """(key, result, reason): what ``parse`` makes of ``column``, as the SQL type
    ``result``, or why it can't.  Null values are parsed like others."""
    src = df.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    kinds = src.sparkSession.createDataFrame([], f"r {result}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(kinds["r"].dataType)
        for b in batches:
            values, reasons = [], []
            for x in b.column("_value").to_pylist():
                try:
                    values.append(parse(x))
                    reasons.append(None)
                except Exception as e:  # the parser's own faults too are the row's
                    values.append(None)
                    reasons.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.record_batch([b.column("_key"), pa.array(values, kind), pa.array(reasons, pa.string())], names=["_key", "_result", "_reason"])

    found = src.mapInArrow(run, f"_key {src.schema['_key'].dataType.simpleString()}, _result {result}, _reason string")
    return found.select(F.col("_key").alias(key), F.col("_result").alias("result"), F.col("_reason").alias("reason"))


class Intake:
    """Good and bad rows of a source, run by run, in one folder."""

    def __init__(self, source: DataFrame, key: str, column: str, result: str, most: int = 3, folder: str | None = None) -> None:
        self.source, self.key, self.column, self.result, self.most = source, key, column, result, most
        self.spark = source.sparkSession
        self.folder = folder or f"{scratch(self.spark)}/intake-{uuid.uuid4().hex}"
        self.kind = source.schema[key].dataType.simpleString()

    def _table(self, name: str, columns: str) -> DataFrame:
        """Rows of all ended runs."""
        found = [self.spark.read.schema(f"{self.key} {self.kind}, {columns}").parquet(f"{self.folder}/run={k}/{name}").withColumn("run", F.lit(k)) for k in self.ended()]
        out = self.spark.createDataFrame([], f"{self.key} {self.kind}, {columns}, run int")
        for f in found:
            out = out.unionByName(f)
        return out

    def ended(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        runs = [s.getPath() for s in fs.listStatus(path)]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in runs if fs.exists(mark(p, "bad/_SUCCESS")))

    def good(self) -> DataFrame:
        """(key, result, attempt, run)."""
        return self._table("good", f"result {self.result}, attempt int")

    def bad(self) -> DataFrame:
        """(key, reason, attempt, run): every failed attempt."""
        return self._table("bad", "reason string, attempt int")

    def open(self) -> DataFrame:
        """(key, reason, attempt): rows that have not been read yet, as they failed last."""
        last = self.bad().groupBy(self.key).agg(F.max(F.struct("attempt", "reason")).alias("l"))
        return last.join(self.good().select(self.key), self.key, "left_anti").select(self.key, "l.reason", "l.attempt")

    def run(self, parse: Callable[[object], object]) -> int:
        """One run over what is new or may be tried again; its number.  The bad rows
        are written last, and end the run."""
        k = max(self.ended(), default=-1) + 1
        failed = self.bad().groupBy(self.key).agg(F.max("attempt").alias("before"))
        todo = self.source.join(self.good().select(self.key), self.key, "left_anti").join(failed, self.key, "left")
        todo = todo.withColumn("before", F.coalesce("before", F.lit(0))).where(F.col("before") < self.most)
        at = f"{self.folder}/run={k}"
        out = tried(todo, self.key, self.column, parse, self.result).join(todo.select(self.key, (F.col("before") + 1).cast("int").alias("attempt")), self.key)
        out.write.mode("overwrite").parquet(f"{at}/all")
        rows = self.spark.read.schema(out.schema).parquet(f"{at}/all")
        rows.where("reason is null").select(self.key, "result", "attempt").write.mode("overwrite").parquet(f"{at}/good")
        rows.where("reason is not null").select(self.key, "reason", "attempt").write.mode("overwrite").parquet(f"{at}/bad")
        return k
