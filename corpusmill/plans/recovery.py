"""Queries whose jobs are broken off and go on: committed streams, mergeable summaries, keyed state, copies; and exact ranks and anti-joins at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from ..shared import new_dir
from ..sources import copying
from ..streaming import stateful, stream
from ..streaming.commitlog import CommitLog, committed
from ..streaming.partials import Summary, summarised


class _BrokenOff(Exception):
    pass


def _once(step: str):
    """Breaks a job off the first time that it comes to a step."""
    left = [step]

    def hook(at: str) -> None:
        if at in left:
            left.clear()
            raise _BrokenOff(at)

    return hook


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return stream.read_stream(spark, path, spark.read.parquet(path))


def _twice(run) -> None:
    """Runs a query again after it has been broken off."""
    try:
        run().awaitTermination()
    except Exception as e:
        if _BrokenOff.__name__ not in str(e):
            raise
        run().awaitTermination()


def stream_commits(spark: SparkSession, d: str) -> DataFrame:
    """Events of a stream that is broken off between staging and commit, and goes on: each once."""
    place = new_dir(spark, "stream")
    log = CommitLog(spark, f"{place}/out", _once("staged"))
    _twice(lambda: committed(_events(spark, d), log, f"{place}/state", lambda b: b.select("event_id", "event_type")))
    return log.read("event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def stream_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary by states that are merged batch by batch, broken off between rows and summary."""
    place = new_dir(spark, "stream")
    out, sums = CommitLog(spark, f"{place}/out"), CommitLog(spark, f"{place}/sums", _once("begun"))
    summary = Summary(sums, ["event_type"], {"n": ("count", F.lit(1)), "total": ("sum", F.round(F.col("value") * 100).cast("long")), "least": ("min", F.col("value")), "most": ("max", F.col("value")), "mean": ("mean", F.col("value"))})
    _twice(lambda: summarised(_events(spark, d), out, summary, f"{place}/state"))
    return summary.now().withColumn("mean", F.round("mean", 4))


SIZE, IDLE = 4, 12 * 3_600_000


def stream_step_windows(spark: SparkSession, d: str) -> DataFrame:
    """Means of each 4 events of a user, or of those up to a pause of 12 hours, and of all so far, from keyed state with timers."""
    place = new_dir(spark, "stream")
    with stateful.rocksdb(spark):
        out = stateful.step_windows(_events(spark, d), "user_id", "ts", "event_id", "value", SIZE, IDLE, "0 seconds")
        stream.to_table(out, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("key", "n", "window_n", F.round(F.col("window_mean") * F.col("window_n") * 100).cast("long").alias("window_cents"), F.round(F.col("mean") * F.col("n") * 100).cast("long").alias("cents"))


def copied_tree(spark: SparkSession, d: str) -> DataFrame:
    """Customers in a folder for each nation, copied by the executors after a copy that was broken off, and read from the copy."""
    place = new_dir(spark, "files")
    spark.read.parquet(f"{d}/customer.parquet").repartition("c_nationkey").write.partitionBy("c_nationkey").json(f"{place}/from")
    try:
        copying.copy_tree(spark, f"{place}/from", f"{place}/to", hook=_once("staged"))
    except _BrokenOff:
        pass
    files = copying.copy_tree(spark, f"{place}/from", f"{place}/to")
    have = spark.read.schema("c_custkey long, c_acctbal double, c_nationkey int").json(f"{place}/to")
    return have.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 1).alias("total")).crossJoin(files.agg((F.count("*") >= F.count_distinct("name")).alias("listed")))  # one row


def price_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Order statistics of all prices as one group, and of each flag's."""
    at = {"low": lambda n: F.lit(0), "median": lambda n: F.floor(n / 2), "p95": lambda n: F.floor((n - 1) * 0.95), "high": lambda n: n - 1}
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    one = ranks.order_statistics(items, [], "l_extendedprice", at).select(F.lit("all").alias("flag"), "n", *at)
    return one.unionByName(ranks.order_statistics(items, ["l_returnflag"], "l_extendedprice", at).withColumnRenamed("l_returnflag", "flag"))


def kept_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't labelled as toxic: few are held out, so few are shuffled."""
    held = spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 1")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")
    return ranks.held_out_few(docs, held, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_RANKS = "count(*) AS n, min(x) AS low, list_sort(list(x))[count(*) // 2 + 1] AS median, list_sort(list(x))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95, max(x) AS high"
ORACLES = {
    "stream_commits": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
    "stream_summary": "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "stream_step_windows": f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_ms(ts) AS ms, value, row_number() OVER w AS n, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS total, epoch_ms(ts) - lag(epoch_ms(ts)) OVER w AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)),
s AS (SELECT *, sum(CASE WHEN pause > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY n) AS part FROM o),
p AS (SELECT *, (row_number() OVER (PARTITION BY key, part ORDER BY n) - 1) // {SIZE} AS piece, max(part) OVER (PARTITION BY key) AS last_part, max(ms) OVER () AS mark FROM s)
SELECT key, max(n) AS n, count(*) AS window_n, CAST(round(sum(value) * 100) AS BIGINT) AS window_cents, CAST(round(max_by(total, n) * 100) AS BIGINT) AS cents FROM p GROUP BY key, part, piece HAVING count(*) = {SIZE} OR part < any_value(last_part) OR max(ms) + {IDLE} < any_value(mark)""",
    "copied_tree": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 1) AS total, true AS listed FROM customer GROUP BY 1",
    "price_ranks": f"SELECT 'all' AS flag, {_RANKS} FROM (SELECT l_extendedprice AS x FROM lineitem) UNION ALL SELECT flag, {_RANKS} FROM (SELECT l_returnflag AS flag, l_extendedprice AS x FROM lineitem) GROUP BY flag",
    "kept_documents": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang",
}
QUERIES = {name: globals()[name] for name in ORACLES}
