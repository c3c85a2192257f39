"""Unordered lists under an equality that isn't transitive: maximum matchings by augmenting rounds.

Two lists are the same if their parts can be paired so that each pair is the same. Within a
tolerance a part may be the same as several that aren't the same as each other, so pairs
can't be taken as they come. All groups (lists to compare) are matched at once: a round grows
alternating trees from all parts without a partner, level by level, in joins on (group,
part); each right part is claimed by one tree, so the paths that are found have no part in
common and are turned together. When a round finds no path in a group, its matching is as
large as any. A group's work is dealt out by its parts, however large it is.

Numbers within one tolerance need no search: in order of size, each takes the first that is
left for it. ``same_numbers`` does this for a group in one row, unless the group is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir


def _kept(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def edges_within(left: DataFrame, right: DataFrame, absolute: float, relative: float) -> DataFrame:
    """(g, l, r) of the numbers x of ``left`` (g, l, x) that lie within max(absolute, relative * abs(y)) of a number y of ``right`` (g, r, y).

    An equi-join on bins: a right number covers two or three bins of its own width, a power of two
    above its tolerance; a left number looks into one bin for each width that its group has. Nulls have no edges.
    """
    slack = F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * F.abs("y"), F.lit(1e-12))
    wide = right.filter("y is not null").withColumn("_t", slack).withColumn("_level", F.ceil(F.log2("_t")).cast("int")).withColumn("_w", F.pow(F.lit(2.0), F.col("_level")))
    bins = wide.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("y") - F.col("_t")) / F.col("_w")), F.floor((F.col("y") + F.col("_t")) / F.col("_w")))))
    levels = wide.groupBy("g", "_level").agg(F.first("_w").alias("_w"))  # few for a group
    probes = left.filter("x is not null").join(levels, "g").withColumn("_bin", F.floor(F.col("x") / F.col("_w"))).drop("_w")
    return probes.join(bins.select("g", "_level", "_bin", "r", "y", "_t"), ["g", "_level", "_bin"]).filter(F.abs(F.col("x") - F.col("y")) <= F.col("_t")).select("g", "l", "r").distinct()


def maximum_matching(edges: DataFrame) -> DataFrame:
    """Of edges (g, l, r) as many as possible for each group of which no two have a part in common. Repeated edges count once."""
    live = _kept(edges.select("g", "l", "r").distinct())
    matched = live.limit(0)
    while True:
        frontier = live.select("g", "l").distinct().join(matched, ["g", "l"], "left_anti").withColumns({"root": F.col("l"), "path": F.expr("CAST(array() AS ARRAY<STRUCT<l:BIGINT,r:BIGINT>>)")})
        claimed, found = None, []
        while True:
            tried = frontier.join(live, ["g", "l"])
            if claimed is not None:
                tried = tried.join(claimed, ["g", "r"], "left_anti")
            step = F.struct(F.col("l"), F.col("root"), F.concat("path", F.array(F.struct(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")))).alias("path"))
            grown = _kept(tried.groupBy("g", "r").agg(F.min(step).alias("s")).select("g", "r", "s.root", "s.path").join(matched.withColumnRenamed("l", "partner"), ["g", "r"], "left"))
            ends = grown.filter("partner is null").groupBy("g", "root").agg(F.min(F.struct("r", "path")).alias("s")).select("g", "s.path")
            found.append(ends)
            reached = grown.select("g", "r")
            claimed = reached if claimed is None else claimed.unionByName(reached)
            over = grown.filter("partner is null").select("g").distinct()  # shortest paths first: a group with one goes no deeper in this round
            frontier = grown.filter("partner is not null").join(over, "g", "left_anti").select("g", F.col("partner").alias("l"), "root", "path")
            if frontier.isEmpty():
                break
        paths = _kept(reduce(DataFrame.unionByName, found))
        if paths.isEmpty():
            return matched
        turned = paths.select("g", F.inline("path"))
        matched = _kept(matched.join(turned.select("g", "l"), ["g", "l"], "left_anti").unionByName(turned))
        live = live.join(paths.select("g").distinct(), "g", "left_semi")  # the others have the largest matching


#: Parts of a group, of both lists together, that are held in one row.
ROW_PARTS = 20_000
_PAIRED = "named_struct('i', 0, 'j', 0, 'n', 0L)"


def _paired(xs: Column, ys: Column, tolerance: float) -> Column:
    """How many numbers of two sorted arrays can be paired within a tolerance: the smaller one of two that are too far apart has no partner among those that follow."""

    def step(s: Column, _: Column) -> Column:
        x, y = F.get(xs, s["i"]), F.get(ys, s["j"])
        near = F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        return F.struct((s["i"] + (near | (x < y)).cast("int")).alias("i"), (s["j"] + (near | (x > y)).cast("int")).alias("j"), (s["n"] + near.cast("long")).alias("n"))

    over = lambda s: (s["i"] >= F.size(xs)) | (s["j"] >= F.size(ys))
    steps = F.sequence(F.lit(0), F.size(xs) + F.size(ys))
    return F.aggregate(steps, F.expr(_PAIRED), lambda s, i: F.when(over(s), s).otherwise(step(s, i)), lambda s: s["n"])


def same_numbers(left: DataFrame, right: DataFrame, tolerance: float, row_parts: int = ROW_PARTS) -> DataFrame:
    """As ``same_lists`` of numbers x of ``left`` (g, l, x) and y of ``right`` (g, r, y) that are the same within ``tolerance``, in one shuffle; groups of more than ``row_parts`` parts go through the rounds. An l and an r name one part of a group."""
    side = lambda df, k, v, is_left: df.select("g", F.lit(is_left).alias("_left"), F.col(k).alias("_k"), F.col(v).cast("double").alias("_v"))
    parts = side(left, "l", "x", True).unionByName(side(right, "r", "y", False))
    large = _kept(parts.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > row_parts).select("g"))
    rest = None
    if not large.isEmpty():
        parts = parts.join(large, "g", "left_anti")
        some, others = left.join(large, "g", "left_semi"), right.join(large, "g", "left_semi")
        rest = same_lists(some, others, edges_within(some, others, tolerance, 0.0))
    finite = (F.abs("_v") < float("inf")) & F.col("g").isNotNull()
    mine = lambda is_left: F.col("_left") == is_left
    values = lambda is_left: F.sort_array(F.collect_list(F.when(mine(is_left) & finite, F.col("_v"))))
    grouped = parts.groupBy("g", F.when(F.col("g").isNull(), F.col("_left")).alias("_own")).agg(  # lists without a group aren't compared
        F.count(F.when(mine(True), F.col("_k"))).alias("n_left"), F.count(F.when(mine(False), F.col("_k"))).alias("n_right"), values(True).alias("_xs"), values(False).alias("_ys"),
    )
    out = grouped.select("g", "n_left", "n_right", _paired(F.col("_xs"), F.col("_ys"), max(float(tolerance), 1e-12)).alias("n_matched")).withColumn("same", (F.col("n_left") == F.col("n_matched")) & (F.col("n_right") == F.col("n_matched")))
    return out if rest is None else out.unionByName(rest)


def same_lists(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """For each group of ``left`` (g, l) or ``right`` (g, r): n_left, n_right, n_matched, and whether all parts are paired."""
    count = lambda df, k, name: df.groupBy("g").agg(F.count(k).alias(name))
    out = count(left, "l", "n_left").join(count(right, "r", "n_right"), "g", "full").join(count(maximum_matching(edges), "l", "n_matched"), "g", "left")
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return out.select("g", zero("n_left"), zero("n_right"), zero("n_matched")).withColumn("same", (F.col("n_left") == F.col("n_matched")) & (F.col("n_right") == F.col("n_matched")))
