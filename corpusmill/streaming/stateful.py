"""Keyed state with timers on a stream: windows of rows with means of the window and of all rows so far.

A window of ``size`` rows is given out when it is full; one that isn't, when its key has been
quiet for ``idle``: by the next row of the key, or by a timer of event time once the watermark
has passed. So what comes out doesn't depend on how rows are cut into batches, as long as a
key's rows come in the order of time; within a batch they are sorted. Each key holds its totals
(value state) and the values of its open window (list state), in RocksDB, so that the state may
be larger than memory. Rows without a value or a time are left out, and so are those older than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAME = "spark.sql.streaming.stateStore.providerClass"
OUT = "key string, n long, window_n long, window_mean double, mean double"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, queries that start keep their state in RocksDB."""
    before = spark.conf.get(_NAME, None)
    spark.conf.set(_NAME, STORE)
    try:
        yield
    finally:
        spark.conf.unset(_NAME) if before is None else spark.conf.set(_NAME, before)


class Windows(StatefulProcessor):
    """Means of each ``size`` rows, or of those up to a pause of more than ``idle_ms``, and of all rows so far."""

    def __init__(self, size: int, idle_ms: int):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, total double, last long, timer long")
        self.open = handle.getListState("open", "x double")

    @staticmethod
    def _emit(key: Any, n: int, total: float, held: list[float]) -> Row:
        return Row(key=key[0], n=n, window_n=len(held), window_mean=sum(held) / len(held), mean=total / n)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, total, last, timer = self.totals.get() if self.totals.exists() else (0, 0.0, 0, 0)
        held = [r[0] for r in self.open.get()] if self.open.exists() else []
        for row in sorted(rows, key=lambda r: (r.ms, r.at)):
            if held and row.ms - last > self.idle_ms:
                yield self._emit(key, n, total, held)
                held = []
            n, total, last = n + 1, total + row.x, row.ms
            held.append(row.x)
            if len(held) == self.size:
                yield self._emit(key, n, total, held)
                held = []
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs()) + 1 if held else 0
        if timer:
            self.handle.registerTimer(timer)
        self.totals.update((n, total, last, timer))
        self.open.put([(x,) for x in held]) if held else self.open.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.open.exists():
            n, total, last, _ = self.totals.get()
            yield self._emit(key, n, total, [r[0] for r in self.open.get()])
            self.open.clear()
            self.totals.update((n, total, last, 0))

    def close(self) -> None:
        pass


def step_windows(df: DataFrame, key: str, ts: str, order: str, value: str, size: int, idle_ms: int, late: str = "1 hour") -> DataFrame:
    """key (a string), its rows so far, rows and mean of the window, mean of all its rows so far; to be started within ``rocksdb``."""
    time = F.col(ts).cast("timestamp")
    rows = df.select(F.col(key).cast("string").alias("key"), time.alias("_ts"), F.unix_millis(time).alias("ms"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND _ts IS NOT NULL")
    return rows.withWatermark("_ts", late).groupBy("key").transformWithState(Windows(size, idle_ms), OUT, "Append", "EventTime")
