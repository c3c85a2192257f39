"""Rules that reject rows: the first that fails, or all that fail, and their audits."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import hash_order, running


class Rule(NamedTuple):
    """``fails`` is true for a row that the rule rejects; null counts as false."""

    label: str
    fails: Column


def first_reason(rules: Sequence[Rule]) -> Column:
    """The label of the first failing rule, null for a row that passes."""
    return F.coalesce(*[F.when(r.fails, F.lit(r.label)) for r in rules], F.lit(None).cast("string"))


def all_reasons(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(r.fails, F.lit(r.label)) for r in rules]))


def reasons_for(is_special: Column, special: Sequence[Rule], ordinary: Sequence[Rule]) -> Column:
    """Two lists of rules, as for anchors and data rows."""
    return F.when(is_special, first_reason(special)).otherwise(first_reason(ordinary))


def apply(df: DataFrame, rules: Sequence[Rule], reason: str = "reason") -> DataFrame:
    return df.withColumn(reason, first_reason(rules))


def kept(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.filter(F.col(reason).isNull()).drop(reason)


def histogram(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def examples(df: DataFrame, key: str, k: int = 20, reason: str = "reason") -> DataFrame:
    """The first k rejected rows of each reason, by key; a literal k lets Spark limit each group before the shuffle."""
    w = Window.partitionBy(reason).orderBy(key)
    return df.filter(F.col(reason).isNotNull()).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def audit(df: DataFrame, rules: Sequence[Rule], key: str, k: int = 3) -> DataFrame:
    """For each violated rule its count and first k keys."""
    hits = df.select(key, F.explode(all_reasons(rules)).alias("rule"))
    counts = hits.groupBy("rule").agg(F.count("*").alias("violations"))
    first = examples(hits, key, k, "rule").groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(first, "rule")


def gate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: rows, violating rows, and whether none violates."""
    bad = F.count_if(first_reason(rules).isNotNull())
    return df.agg(F.count("*").alias("rows"), bad.alias("bad"), (bad == 0).alias("passed"))


def capped(df: DataFrame, reason: str, by: str, key: str, cap: int, seed: str, label: str = "cap_reached") -> DataFrame:
    """Rows in hash order by group: after the cap-th one without a reason, all get ``label``. Groups spread over ranges; give the columns that are needed only, as whole rows are sorted."""
    taken = running(df.withColumn("_hash", hash_order(seed, key)[0]), [by], ["_hash", key], {"_before": F.col(reason).isNull().cast("long")})
    return taken.withColumn(reason, F.when(F.col("_before") >= cap, F.lit(label)).otherwise(F.col(reason))).drop("_hash", "_before")


def threshold(x: Column, least: float, bad: str = "bad_value", below: str = "below_threshold") -> list[Rule]:
    """A value that is no number has a reason of its own."""
    number = F.trim(x).try_cast("double")
    return [Rule(bad, number.isNull()), Rule(below, number < least)]


def source_rules(source: str, allowed: Sequence[str], blocked: Sequence[str] = ()) -> list[Rule]:
    """Blocked sources have a reason of their own, whether allowed or not; a null source is allowed nowhere."""
    return [Rule("blocked_source", F.col(source).isin(*blocked)), Rule("disallowed_source", ~F.coalesce(F.col(source).isin(*allowed), F.lit(False)))]


def like_any(x: str, parts: Sequence[str]) -> Column:
    """Whether a text has one of the parts, in any case."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(F.col(x)), F.lower(p)))


def within(df: DataFrame, low: int, high: int, blocked: Column) -> DataFrame:
    """One row: the number of rows, that of blocked ones, and whether the first is in range and the second 0."""
    return df.agg(F.count("*").alias("rows"), F.count_if(blocked).alias("blocked")).withColumn("passed", F.col("rows").between(low, high) & (F.col("blocked") == 0))


def length_cap(df: DataFrame, tokens: str, most: int, key: str, by: str, k: int = 5) -> DataFrame:
    """For each group: rows, kept ones, the longest and mean length, and the first k keys that are too long."""
    over = F.col(tokens) > most
    counts = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~over).alias("kept"), F.max(tokens).alias("longest"), F.round(F.avg(tokens), 4).alias("mean"))
    first = examples(df.filter(over).withColumn("_reason", F.col(by)), key, k, "_reason").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(first, by, "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def prefix_count(df: DataFrame, prefix: str, reason: str = "reason") -> DataFrame:
    """One row: rejected rows, and those whose reason begins with ``prefix``."""
    return df.agg(F.count(reason).alias("rejected"), F.count_if(F.startswith(F.col(reason), F.lit(prefix))).alias("with_prefix"))
