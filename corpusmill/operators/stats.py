"""Aggregates: order statistics, evaluation metrics, overlapping splits, cross-tabs, roll-ups and deltas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0.0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def index_stats(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """min, v[n div 2], v[int(0.95 (n - 1))] and max of the sorted values, by rank: no list of a group is held anywhere."""
    counted = df.groupBy(*by, x).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy(x)
    placed = counted.withColumns({"_to": F.sum("_k").over(w), "_n": F.sum("_k").over(Window.partitionBy(*by))}).withColumn("_from", F.col("_to") - F.col("_k"))
    at = lambda i: F.min(F.when((i >= F.col("_from")) & (i < F.col("_to")), F.col(x)))
    return placed.groupBy(*by).agg(F.max("_n").alias("n"), F.min(x).alias("min"), at(F.floor(F.col("_n") / 2)).alias("median"), at(F.floor((F.col("_n") - 1) * 0.95)).alias("p95"), F.max(x).alias("max"))


def interpolated(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The interpolated median, cut to an integer, and the exclusive 95 % quantile (rank 0.95 (n + 1))."""
    counted = df.groupBy(*by, x).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy(x)
    placed = counted.withColumns({"_to": F.sum("_k").over(w), "_n": F.sum("_k").over(Window.partitionBy(*by))}).withColumn("_from", F.col("_to") - F.col("_k"))
    at = lambda i: F.min(F.when((i > F.col("_from")) & (i <= F.col("_to")), F.col(x)))
    n = F.col("_n")
    rank = F.greatest(F.lit(1.0), F.least(0.95 * (n + 1), n.cast("double")))
    low = placed.groupBy(*by).agg(F.max("_n").alias("n"), at(F.floor((n + 1) / 2)).alias("_a"), at(F.floor(n / 2) + 1).alias("_b"), at(F.floor(rank)).alias("_c"), at(F.ceil(rank)).alias("_d"), F.max(rank - F.floor(rank)).alias("_f"))
    return low.select(*by, "n", F.floor((F.col("_a") + F.col("_b")) / 2).alias("median"), (F.col("_c") + (F.col("_d") - F.col("_c")) * F.col("_f")).alias("p95"))


def eval_metrics(correct: str = "correct", mcq: str = "is_mcq", multi: str = "is_multi", words: str = "words", ok: str = "format_ok") -> list[Column]:
    """Accuracy is 0.0 without rows; that of an empty subset is null."""
    hit = F.col(correct).cast("double")
    return [
        F.count("*").alias("n"), F.coalesce(F.round(F.avg(hit), 6), F.lit(0.0)).alias("accuracy"), F.count_if(correct).alias("correct"), F.round(F.avg(F.when(F.col(mcq), hit)), 6).alias("mcq_accuracy"), F.count_if(mcq).alias("mcq_total"),
        F.round(F.avg(F.when(F.col(multi), hit)), 6).alias("multi_accuracy"), F.count_if(multi).alias("multi_total"), F.round(F.avg(words), 6).alias("avg_words"), F.round(F.avg(F.col(ok).cast("double")), 6).alias("format_rate"),
    ]


def overlapping_splits(df: DataFrame, members: Mapping[str, Column], correct: str = "correct") -> DataFrame:
    """Counts by split; a row can be in several, a split without rows has zeros."""
    names = df.sparkSession.createDataFrame([(k,) for k in members], "split string")
    tagged = df.select(correct, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in members.items()]))).alias("split"))
    got = tagged.groupBy("split").agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"))
    full = names.join(got, "split", "left").na.fill(0, ["n", "correct"])
    return full.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("n")), 6))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(col, values).count().na.fill(0)


def zero_filled(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Counts of key for each value from low to high."""
    every = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(key))
    return every.join(df.groupBy(F.col(key).cast("int").alias(key)).agg(F.count("*").alias("n")), key, "left").na.fill(0, ["n"])


def rolled_up(df: DataFrame, by: list[str], correct: str) -> DataFrame:
    return df.rollup(*by).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def two_arms(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Both arms' accuracies and their difference, by group."""
    x, y = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(x, 6).alias("base"), F.round(y, 6).alias("other"), F.round(y - x, 6).alias("delta"), F.count_if(F.col(b) & ~F.col(a)).alias("gained"), F.count_if(F.col(a) & ~F.col(b)).alias("lost"))


def failure_modes(scored: DataFrame, strict: str, ok: str, mode: str) -> DataFrame:
    """Counts by mode of rescued rows, and of rows that failed or ran out of time."""
    broken = F.startswith(F.col(mode), F.lit("error:")) | (F.col(mode) == "timeout")
    return scored.filter((F.col(ok) & ~F.col(strict)) | broken).groupBy(mode).agg(F.count("*").alias("n"))


def file_reports(scored: DataFrame, path: str, strict: str, ok: str) -> DataFrame:
    """One report for each file, and one of all with a null path unless there is only one file."""
    s, k = F.col(strict).cast("double"), F.col(ok).cast("double")
    cells = [F.count("*").alias("n"), F.count_if(strict).alias("strict_correct"), F.count_if(ok).alias("capability_correct"), F.count_if(F.col(ok) & ~F.col(strict)).alias("rescued"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("strict_accuracy"), F.round(F.coalesce(F.avg(k), F.lit(0.0)), 6).alias("capability_accuracy")]
    rolled = scored.rollup(path).agg(F.grouping(path).alias("_all"), F.count_distinct(path).alias("_files"), *cells)
    return rolled.filter("_all = 0 or _files <> 1").drop("_all", "_files")


def merge_counts(reports: DataFrame, counts: str) -> DataFrame:
    """The sums of all reports' counters (maps from a label to a number)."""
    return reports.select(F.explode(counts).alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))


def interpolated_weights(base: DataFrame, tuned: DataFrame, layers: int, low: float, high: float, other: float) -> DataFrame:
    """name and values of ``base`` moved towards ``tuned`` (name, values), by ``high`` in the first layer falling to ``low`` in the last, by ``other`` outside of layers; tensors that ``tuned`` lacks stay."""
    layer = F.nullif(F.regexp_extract("name", r"\.layers\.(\d+)\.", 1), F.lit("")).cast("int")
    part = F.when(layer.isNotNull(), F.lit(high) + layer / F.lit(float(max(layers - 1, 1))) * F.lit(low - high)).otherwise(F.lit(other))
    both = base.join(tuned.select("name", F.col("values").alias("_to")), "name", "left").withColumn("_by", part)
    moved = F.transform("values", lambda x, i: x + F.col("_by") * (F.get("_to", i) - x))
    return both.select("name", F.when(F.col("_to").isNull(), F.col("values")).otherwise(moved).alias("values"))


def pass_band(attempts: DataFrame, key: str, correct: str) -> DataFrame:
    """Passes of each key; those that always or never pass are marked."""
    n = attempts.groupBy(key).agg(F.count("*").alias("n"), F.count_if(correct).alias("passed"))
    return n.withColumn("band", F.when(F.col("passed") == 0, "too_hard").when(F.col("passed") == F.col("n"), "too_easy").otherwise("kept"))


def difficulty_level(d: Column) -> Column:
    """1 (hardest) to 5; values between the named ones have no level."""
    return F.when(d.between(9, 10), 1).when(d.between(7, 8), 2).when(d == 6, 3).when(d == 5.5, 4).when(d == 5, 5)
