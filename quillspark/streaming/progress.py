"""Progress as a table: what passed each phase of each batch of a stream.

Phases are observed where they stand in the plan; a listener takes the metrics of
every batch as Spark reports them, and :meth:`Progress.table` gives them as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

COLUMNS = "run string, batch long, phase string, n_rows long, total double, read_rows long, duration_ms long"


def phase(df: DataFrame, name: str, value: str | Column) -> DataFrame:
    """``df`` with its rows and the sum of ``value`` observed under ``name``."""
    col = F.col(value) if isinstance(value, str) else value
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"), F.sum(col.cast("double")).alias("total"))


class Progress(StreamingQueryListener):
    """The metrics of the phases of all streams of one name."""

    def __init__(self, run: str) -> None:
        self.run, self.rows, self.failed, self.ended = run, [], [], 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.run:
            for name, m in p.observedMetrics.items():
                self.rows.append((self.run, p.batchId, name, m["n_rows"], m["total"], p.numInputRows, int(p.batchDuration)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
        if event.exception:
            self.failed.append(event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each phase and batch; rows of a batch that was run again count once."""
        last = {(r[0], r[1], r[2]): r for r in self.rows}
        return spark.createDataFrame(sorted(last.values(), key=lambda r: r[:3]), COLUMNS)

    def wait(self, spark: SparkSession, ended: int = 1) -> None:
        """Until the listener has been told of all that happened before ``ended`` queries ended."""
        import time

        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(200):
            if self.ended >= ended:
                return
            time.sleep(0.05)
        raise TimeoutError("the listener was not told of the end of the stream")


def formatted(table: DataFrame, phases: Sequence[str]) -> DataFrame:
    """(run, batch, message): the batch's phases in order, as text for a reader."""
    part = F.struct(F.array_position(F.array(*[F.lit(x) for x in phases]), F.col("phase")).alias("k"), F.format_string("%s %d", "phase", "n_rows").alias("t"))
    return table.groupBy("run", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.t), ", ").alias("message"))
