"""Version stacks kept in a state store, from batch to batch.

The store holds for each key one entry for each set of anchors, not the log: an
entry replaces the one of its set if it is later, whatever order entries arrive
in.  A key whose stack got no entry for ``idle`` of event time is closed: its last
state is emitted once more, marked so, and its entries go.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start in here keep their state in RocksDB."""
    had = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, had)


def _stack(entries: list[tuple[str, int, str, float | None]]) -> tuple[int, float | None]:
    """Depth and current snapshot of (set, at, kind, snapshot)."""
    again = [e for e in entries if e[2] == "re_spec"]
    top = max(again or entries, key=lambda e: e[1])
    return len(entries), top[3]


class VersionStack(StatefulProcessor):
    """Rows (set, at, kind, snapshot, ts) folded by key."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "anchors string", "at long, kind string, snapshot double")
        self.timer = handle.getValueState("timer", "at long")

    def _all(self) -> list[tuple]:
        return [(k[0], *v) for k, v in self.entries.iterator()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, last = {}, 0
        for frame in rows:
            for r in frame.itertuples():
                if r.anchors not in newest or r.at > newest[r.anchors][0]:
                    newest[r.anchors] = (int(r.at), r.kind, None if pd.isna(r.snapshot) else float(r.snapshot))
                last = max(last, int(r.ts.timestamp() * 1000)) if self.idle is not None else 0
        for name, entry in newest.items():
            held = self.entries.getValue((name,))
            if held is None or entry[0] > held[0]:
                self.entries.updateValue((name,), entry)
        if self.idle is not None:
            old = self.timer.get()
            if old is None or last + self.idle > old[0]:
                if old is not None:
                    self.handle.deleteTimer(old[0])
                self.handle.registerTimer(last + self.idle)
                self.timer.update((last + self.idle,))
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self._row(key, True)
        self.entries.clear()
        self.timer.clear()
        yield row

    def _row(self, key, closed: bool) -> pd.DataFrame:
        depth, current = _stack(self._all())
        return pd.DataFrame({"key": [key[0]], "depth": [depth], "current": [current], "closed": [closed]})

    def close(self) -> None:
        pass


def version_stacks(entries: DataFrame, key: str, at: str, ts: str, anchors: str, snapshot: str, kind: str = "kind", idle: str | None = None, late: str = "1 day") -> DataFrame:
    """(key, depth, current, closed) of a stream of entries, for the keys that a
    batch touches: see :func:`quillspark.operators.state.version_stack`.  With
    ``idle`` (an interval such as "2 days") stacks are closed after it."""
    own = F.when(F.col(kind) == "re_spec", F.array_join(F.array_sort(F.array_distinct(anchors)), "|")).otherwise("origin")
    rows = entries.select(F.col(key).alias("key"), own.alias("anchors"), F.col(at).cast("long").alias("at"), F.col(kind).alias("kind"), F.col(snapshot).cast("double").alias("snapshot"), F.col(ts).cast("timestamp").alias("ts"))
    out = f"key {rows.schema['key'].dataType.simpleString()}, depth long, current double, closed boolean"
    if idle is None:
        return rows.groupBy("key").transformWithStateInPandas(VersionStack(), out, "Update", "None")
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(VersionStack(ms), out, "Update", "EventTime")
