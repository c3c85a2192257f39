"""Joins: lookups, held-out and resume splits, overlays, deduplication and overlap with a benchmark.

Sides are never broadcast by hand: Spark broadcasts those that it knows to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import global_rank

#: Hashes that are broadcast at most: 8 bytes each.
BROADCAST_ROWS = 1_000_000


def lookup(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    return df.join(side, key, "left")


def lookup_all(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """An inner join that fails if a row has no match."""
    missing = df.join(side, key, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"a row has no match by {key}")
    return df.join(side, key)


def held_out(df: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't held out; a null key isn't."""
    return df.join(held.select(key), key, "left_anti")


def resume(todo: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(results of rows that are to be done, rows that are still to be done)."""
    return done.join(todo.select(key), key, "left_semi"), todo.join(done.select(key), key, "left_anti")


def done_key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *parts)


def first_by(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def overlay(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both; of one key the new one's, and of these the first."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return first_by(both, [key], "_age", order).drop("_age")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def overlay_compare(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """base's value and other's, which is false where there is none."""
    right = other.select(key, F.col(value).alias("other_value"))
    return base.join(right, key, "left").withColumn("other_value", F.coalesce("other_value", F.lit(False)))


def overlap(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """doc_id and item_id of documents that have a run of ``words`` words of an item.

    A run is two 64-bit hashes of its words' hashes, so no text but the words is ever built or
    sent. Where the items' runs are few enough, their first hashes are broadcast and only the
    documents' runs that are among them leave the scan; else both sides are joined by hash.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda x: x != "")
        each = df.select(key, w.alias("w")).filter(F.size("w") >= words)
        each = each.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("a"), F.transform("w", lambda x: F.xxhash64(F.lit(1), x)).alias("b"))
        at = F.sequence(F.lit(1), F.size("a") - (words - 1))
        found = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice("a", i, words)).alias("hash"), F.xxhash64(F.slice("b", i, words)).alias("other")))
        return each.select(key, F.inline(found))

    wanted = runs(items, "item_id").distinct()
    hashes = wanted.select("hash").distinct()
    few = hashes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    seen = runs(docs, "doc_id")
    seen = seen.join(F.broadcast(hashes), "hash", "left_semi") if few else seen  # BROADCAST_ROWS hashes at most
    return seen.join(wanted, ["hash", "other"]).select("doc_id", "item_id").distinct()


def zip_by_position(df: DataFrame, other: DataFrame, order: str, other_order: str) -> DataFrame:
    """Rows of both tables at the same rank of their own total orders; other lengths fail the query."""
    a, b = df.count(), other.count()
    if a != b:
        raise ValueError(f"{a} rows and {b} rows can't be zipped")
    return global_rank(df, [order], "_at").join(global_rank(other, [other_order], "_at"), "_at").drop("_at")


def latest_counts(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Of parts in the order of their priority the first row of each key; and one row: rows without a key, and rows that an earlier one hides."""
    every = parts[0].withColumn("_part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_part", F.lit(k)), allowMissingColumns=True)
    known = first_by(every.filter(F.col(key).isNotNull()), [key], "_part").drop("_part")
    counts = every.agg(F.count_if(F.col(key).isNull()).alias("bad"), (F.count(key) - F.count_distinct(key)).alias("hidden"))
    return known, counts


def with_group(df: DataFrame, by: list[str], value: str, name: str = "group") -> DataFrame:
    """Each row with its group's values, in order: for groups of a bounded size, as the samples of one prompt are."""
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))
    return df.join(groups, by)
