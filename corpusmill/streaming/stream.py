"""Structured Streaming: resumable micro-batches, event-time windows, deduplication and running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import remove
from ..sources.sinks import batch_writer


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files in the folder ``path``, or of that one file."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def event_windows(events: DataFrame, ts: str, width: str, keys: list[str], aggregates: list[Column], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; a time without zone is taken as UTC of the session."""
    at = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return at.groupBy(F.window("_ts", width, slide), *keys).agg(*aggregates)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], late: str = "1 hour") -> DataFrame:
    at = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return at.groupBy(F.session_window("_ts", gap), *keys).agg(*aggregates)


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of the rows of one key within the watermark; state older than that is dropped."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys)


def resumable(df: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """All that has arrived, batch by batch; a run that is broken off goes on where it was, and a repeated batch replaces itself."""
    write = batch_writer(out)
    return df.writeStream.foreachBatch(lambda batch, i: write(transform(batch), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_orphan(spark: SparkSession, out: str, checkpoint: str) -> bool:
    """Drops a checkpoint whose output is gone, so that the stream starts anew; tells whether it did."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    here, there = fs.Path(out), fs.Path(checkpoint)
    if there.getFileSystem(conf).exists(there) and not here.getFileSystem(conf).exists(here):
        remove(spark, checkpoint)
        return True
    return False


def partial_results(df: DataFrame, out: str, summary: str, checkpoint: str, aggregate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each batch replaces its own part of the results, then the summary over all parts so far is written anew."""
    write = batch_writer(out)

    def step(batch: DataFrame, i: int) -> None:
        write(batch, i)
        aggregate(batch.sparkSession.read.parquet(out)).write.mode("overwrite").parquet(summary)

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_windows(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """key, window, n and mean of each ``size`` rows of a key in the order in which they come; a window that isn't full stays in the state until it is.

    Within a batch rows count in ``order``.
    """
    kind = dict(df.dtypes)[key]

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, n, total = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for x in rows[value].tolist():
            n, total = n + 1, total + x
            if n == size:
                out.append((keys[0], window, n, total / n))
                window, n, total = window + 1, 0, 0.0
        state.update((window, n, total))
        yield pd.DataFrame(out, columns=["key", "window", "n", "mean"])

    return df.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"key {kind}, window long, n long, mean double", "window long, n long, total double", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Rows, batches and the rate of a query as it goes, and the seconds that are left of ``expected`` rows."""

    def __init__(self, expected: int | None = None):
        self.expected, self.rows, self.batches, self.rate = expected, 0, 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows, self.batches, self.rate = self.rows + p.numInputRows, self.batches + 1, p.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def seconds_left(self) -> float | None:
        return max(0, self.expected - self.rows) / self.rate if self.expected is not None and self.rate > 0 else None


def to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The whole result after each batch, the last one's stays: for aggregates that fit a table."""
    return df.writeStream.outputMode("complete").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
