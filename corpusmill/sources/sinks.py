"""Sinks: JSON lines, manifests, CSV reports, tagged routers and idempotent batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.select import global_rank


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; a missing value is the empty string."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_indexed(df: DataFrame, path: str, *order: str) -> None:
    """Rows with their index in a total order."""
    global_rank(df, list(order), "index").write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, *order: str) -> None:
    """One file with a JSON array of the rows in order, each with its index; a single writer streams the lines."""
    ranked = global_rank(df, list(order), "index")
    last = ranked.agg(F.max("index").alias("_last"))
    line = F.concat(F.when(F.col("index") == 0, "[").otherwise(","), F.to_json(F.struct("index", *df.columns), {"ignoreNullFields": "false"}), F.when(F.col("index") == F.col("_last"), "]").otherwise(""))
    ranked.crossJoin(F.broadcast(last)).select("index", line.alias("value")).coalesce(1).sortWithinPartitions("index").select("value").write.mode("overwrite").text(path)  # last is one row


def append_log(summary: DataFrame, path: str) -> None:
    """A summary's rows go to the end of a log of JSON lines."""
    summary.coalesce(1).write.mode("append").json(path)


def sidecar_path(path: str, suffix: str = "_capability_rescues") -> str:
    folder, _, name = path.rpartition("/")
    stem = name.rsplit(".", 1)[0]
    return f"{folder}/{stem}{suffix}.jsonl" if folder else f"{stem}{suffix}.jsonl"


def write_sidecar(df: DataFrame, keep: Column, path: str) -> str:
    """The rows of ``keep`` beside the input they come from; gives their path."""
    out = sidecar_path(path)
    df.filter(keep).write.mode("overwrite").json(out)
    return out


def error_lines(df: DataFrame, number: str, fields: list[str]) -> DataFrame:
    """Rows as text for people: a numbered head, then a line for each field."""
    parts = [F.format_string("--- error %d ---", F.col(number))] + [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("-"))) for f in fields]
    return df.select(F.concat_ws("\n", *parts).alias("value"))


def write_error_log(df: DataFrame, path: str, number: str, fields: list[str]) -> None:
    error_lines(df, number, fields).write.mode("overwrite").text(path)


def fixed_width(df: DataFrame, widths: dict[str, int], right: tuple[str, ...] = ()) -> DataFrame:
    """Rows as lines of a table with columns of fixed widths; longer values are cut."""
    cells = [(F.lpad if c in right else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("-")), n, " ") for c, n in widths.items()]
    return df.select(F.concat_ws("  ", *cells).alias("line"))


def copy_tree(spark, source: str, target: str) -> None:
    """Copies a folder between any two file systems that Spark can open."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = fs.Path(source), fs.Path(target)
    if not fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf):
        raise OSError(f"{source} can't be copied to {target}")


def write_bytes(spark, path: str, content: bytes) -> None:
    """One small file, replaced as a whole: it is written under another name and renamed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(content))
        stream.hsync()
    finally:
        stream.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{new} can't be renamed")


def read_bytes(spark, path: str) -> bytes | None:
    """A small file's content, or None if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _numbered(spark, path: str) -> list[str]:
    """The numbered files of a progress file, the newest last."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(n for x in found if (n := x.getPath().toString()).rpartition(".")[2].isdigit())


def write_progress(spark, path: str, content: bytes) -> None:
    """A small record that is replaced: the new one gets the next number before the old ones go, so that there is one at every moment."""
    old = _numbered(spark, path)
    write_bytes(spark, f"{path}.{int(old[-1].rpartition('.')[2]) + 1 if old else 0:012d}", content)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for x in old:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        gone.getFileSystem(conf).delete(gone, False)


def read_progress(spark, path: str) -> bytes | None:
    """The newest record, or None before the first."""
    found = _numbered(spark, path)
    return read_bytes(spark, found[-1]) if found else None


def full_manifest(df: DataFrame, reason: str, source: str, words: str, caps: dict[str, int], parameters: dict[str, str]) -> DataFrame:
    """One row: kept and dropped rows, drops by reason, kept rows by source, words of kept rows, and the caps and parameters of the build."""
    kept = F.col(reason).isNull()
    totals = df.agg(F.count_if(kept).alias("rows"), F.count_if(~kept).alias("dropped"), F.coalesce(F.sum(F.when(kept, F.col(words))), F.lit(0)).alias("words"))
    counts = lambda rows, key, name: rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(key, F.lit("")), "n")))).alias(name))  # noqa: E731  a row for each reason or source
    literal = lambda values, kind: F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]) if values else F.create_map().cast(f"map<string,{kind}>")
    both = totals.crossJoin(counts(df.filter(~kept), reason, "drops")).crossJoin(counts(df.filter(kept), source, "sources"))  # one row each
    return both.withColumns({"caps": literal(caps, "int"), "parameters": literal(parameters, "string")})


def write_splits(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def route(df: DataFrame, accepted: Column, good: str, bad: str, dry_run: bool = False) -> DataFrame:
    """Accepted rows to ``good``, others to ``bad``; gives both counts. A dry run writes nothing."""
    tagged = df.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
    if not dry_run:
        for path, keep in ((good, F.col("_ok")), (bad, ~F.col("_ok"))):
            tagged.filter(keep).drop("_ok").write.mode("overwrite").json(path)
    return tagged.agg(F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("rejected"))


def manifest(df: DataFrame, source: str = "source", words: str | None = None) -> DataFrame:
    """One row: rows, rows by source and, with ``words``, the number of words."""
    by = df.groupBy(source).agg(F.count("*").alias("n"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(source, F.lit("")), "n")))).alias("sources"))
    if words is None:
        return total
    return total.crossJoin(df.agg(F.coalesce(F.sum(words), F.lit(0)).alias("words")))  # one row each


def concat_existing(reads: list[Callable[[], DataFrame]]) -> DataFrame | None:
    """The union of those inputs that exist."""
    from pyspark.errors import AnalysisException

    out = None
    for read in reads:
        try:
            df = read()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch has a folder of its own, so that one which runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
