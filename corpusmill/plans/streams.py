"""Queries on the event table as a stream: each runs to the end of what there is and returns the sink's table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import new_dir, remove
from ..streaming import stream


def _place(spark) -> str:
    return new_dir(spark, "stream")


def _events(spark, d):
    path = f"{d}/events.parquet"
    return stream.read_stream(spark, path, spark.read.parquet(path))


def stream_event_windows(spark, d):
    place = _place(spark)
    per = stream.event_windows(_events(spark, d), "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")])
    stream.complete(per, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 1).alias("total"))


def stream_resume(spark, d):
    place = _place(spark)
    for _ in range(2):  # the second run finds nothing new
        stream.resumable(_events(spark, d), f"{place}/out", f"{place}/state", lambda b: b.filter("value > 50")).awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_dedup(spark, d):
    place = _place(spark)
    twice = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    stream.to_table(stream.deduplicated(twice, "ts", ["event_id"], "40 days"), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_restart(spark, d):
    """A checkpoint whose output is gone is dropped, so that the second run reads all again; one with its output is kept."""
    place, out = _place(spark), []
    for k in range(3):
        fresh = stream.without_orphan(spark, f"{place}/out", f"{place}/state")
        stream.resumable(_events(spark, d), f"{place}/out", f"{place}/state").awaitTermination()
        out.append((k, fresh, spark.read.parquet(f"{place}/out").count()))
        if k == 0:
            remove(spark, f"{place}/out")
    return spark.createDataFrame(out, "run long, restarted boolean, n long")


def stream_partial(spark, d):
    """Results by batch and a summary over all batches so far."""
    place = _place(spark)
    total = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 1).alias("total"))
    stream.partial_results(_events(spark, d), f"{place}/out", f"{place}/summary", f"{place}/state", total).awaitTermination()
    return spark.read.parquet(f"{place}/summary")


def stream_sessions(spark, d):
    place = _place(spark)
    rows = _events(spark, d)
    per = stream.sessions(rows, "ts", "6 hours", ["user_id"], [F.count("*").alias("n")], "40 days")
    stream.complete(per, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def stream_count_windows(spark, d):
    """Means of each 25 events of a type, as they come."""
    place = _place(spark)
    rows = _events(spark, d).select("event_type", "event_id", F.round("value", 2).alias("value"))
    stream.to_table(stream.count_windows(rows, "event_type", "event_id", "value", 25), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select(F.col("key").alias("event_type"), "window", "n", F.round("mean", 4).alias("mean"))


def stream_progress(spark, d):
    place, listener = _place(spark), stream.Progress(expected=10**9)
    spark.streams.addListener(listener)
    try:
        stream.resumable(_events(spark, d), f"{place}/out", f"{place}/state").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(listener.rows, listener.batches > 0, listener.seconds_left() is not None)], "rows long, some_batches boolean, estimated boolean")


ORACLES = {
    "stream_event_windows": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(round(sum(value), 2), 1) AS total FROM events GROUP BY 1, 2",
    "stream_resume": "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
}
ORACLES |= {
    "stream_restart": "SELECT run, run = 1 AS restarted, n FROM (SELECT count(*) AS n FROM events), range(3) AS t(run)",
    "stream_partial": "SELECT event_type, count(*) AS n, round(sum(value), 1) AS total FROM events GROUP BY 1",
    "stream_sessions": "SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 6 HOURS) AS sessions, count(*) AS n FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY 1",
    "stream_count_windows": "SELECT event_type, w AS \"window\", count(*) AS n, round(avg(v), 4) AS mean FROM (SELECT event_type, round(value, 2) AS v, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 25 AS w FROM events) GROUP BY event_type, w HAVING count(*) = 25",
    "stream_progress": "SELECT count(*) AS rows, true AS some_batches, true AS estimated FROM events",
}
QUERIES = {name: globals()[name] for name in ORACLES}
