"""Sources: line-wise and whole JSON, globs, optional and cached inputs, and normalisers of loosely typed fields.

All readers take paths that Spark can open; none opens a file itself.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """One record a line; blank lines are skipped, a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_jsonl_tolerant(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """Only lines that are JSON objects; others are skipped."""
    lines = spark.read.text(paths).filter(F.ltrim("value").startswith("{"))
    if isinstance(schema, StructType):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").filter("_bad is null").drop("_bad")


def read_json_document(spark: SparkSession, paths: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """Whole-file documents, with the file's path in ``input_path``."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(paths).withColumn("input_path", F.input_file_name())


def step_of(path: Column | str, pattern: str = r"checkpoint-(\d+)") -> Column:
    """The number in a file name; the query fails where there is none."""
    text = F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return F.when(text.isNull(), F.raise_error(F.concat(F.lit("no step in "), path)).cast("int")).otherwise(text.cast("int"))


def expand_inputs(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """The paths that each pattern matches, sorted; a pattern that matches nothing stands for itself."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path)
        names = sorted(s.getPath().toString() for s in found) if found else []
        out += names or [pattern]
    return out


def numbered_dirs(spark: SparkSession, root: str, prefix: str = "checkpoint-") -> list[int]:
    """Numbers of the sub-folders ``prefix``N, ascending."""
    names = (p.rstrip("/").rsplit("/", 1)[1] for p in expand_inputs(spark, [f"{root}/{prefix}*"]))
    return sorted(int(n[len(prefix) :]) for n in names if n[len(prefix) :].isdigit())


def read_optional(read: Callable[[], DataFrame], spark: SparkSession, schema: StructType | str) -> DataFrame:
    """What ``read`` gives, or an empty table if its path doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cache_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; it is built and written first if it isn't there or ``force`` is set."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_mirror(spark: SparkSession, root: str, name: str, config: str = "default", split: str = "train") -> DataFrame:
    """A split of a dataset in a local mirror laid out as root/name/config/split*.parquet."""
    return spark.read.parquet(f"{root}/{name}/{config}/{split}*.parquet")


def read_split_dirs(spark: SparkSession, path: str, split: str, by: str = "split") -> DataFrame:
    """One split of a dataset that was saved with a folder for each."""
    return spark.read.parquet(path).filter(F.col(by) == split).drop(by)


def read_zip_json(spark: SparkSession, paths: str | list[str], member: str, schema: StructType | str) -> DataFrame:
    """The records of a member (a JSON array, or JSON lines) of zip archives, an archive to a task."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    text = archive.read(member).decode()
                if text.lstrip().startswith("["):
                    records = [json.dumps(r, ensure_ascii=False) for r in json.loads(text)]
                else:
                    records = [line for line in text.split("\n") if line.strip()]
                yield pd.DataFrame({"line": records}, dtype="object")

    lines = spark.read.format("binaryFile").load(paths).select("content").mapInPandas(members, "line string")
    return lines.select(F.from_json("line", schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def first_readable(reads: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The first reader that finds its path."""
    last: AnalysisException | None = None
    for read in reads:
        try:
            return read()
        except AnalysisException as e:
            last = e
    raise last or ValueError("no reader is given")


def check_count(df: DataFrame, expected: int) -> DataFrame:
    """The table, if it has as many rows as its manifest says."""
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows, {expected} are expected")
    return df


def string_or_list(x: Column | str) -> Column:
    """An answer that is a string or a JSON list, as a list; a string like the interval [0, 1) stays one part, a null is empty."""
    c = F.col(x) if isinstance(x, str) else x
    parsed = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}))
    quoted = F.rlike(c, F.lit(r'^\s*\[\s*(?:"|\])'))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(quoted & parsed.isNotNull(), parsed).otherwise(F.array(c))
