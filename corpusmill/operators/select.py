"""Selection without random state: order, caps, quotas, shares, apportionment and curricula.

"Shuffled with seed s" is the order of md5(s:key), then the key, on any engine.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir


#: Levels of a curriculum that are broadcast at most.
BROADCAST_LEVELS = 10_000


def hash_key(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_order(seed: str, key: str) -> list[Column]:
    return [hash_key(seed, key), F.col(key)]


def uniform(x: Column) -> Column:
    """A number in [0, 1) from a string."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sample(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """Exactly n rows, or all: a top-n, no full sort."""
    return df.orderBy(*hash_order(seed, key)).limit(n)


def cap_per_group(df: DataFrame, by: list[str], cap: int, seed: str, key: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*hash_order(seed, key))
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= cap).drop("_nth")


def quotas(df: DataFrame, by: str, want: Mapping[str, int], seed: str, key: str) -> DataFrame:
    """As many rows of each group as ``want`` says, or all; groups not named get none."""
    n = F.create_map(*[F.lit(x) for kv in want.items() for x in kv])
    w = Window.partitionBy(by).orderBy(*hash_order(seed, key))
    most = max(want.values(), default=0)
    ranked = df.filter(F.col(by).isin(*want)).withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= most)
    return ranked.filter(F.col("_nth") <= F.element_at(n, F.col(by))).drop("_nth")


def shortages(df: DataFrame, by: str, want: Mapping[str, int]) -> DataFrame:
    """The groups of ``want`` that have fewer rows than wanted: wanted, have and short."""
    asked = df.sparkSession.createDataFrame(sorted(want.items()), f"{by} string, wanted long")
    have = df.filter(F.col(by).isin(*want)).groupBy(by).agg(F.count("*").alias("have"))
    return asked.join(have, by, "left").select(by, "wanted", F.coalesce("have", F.lit(0)).alias("have")).filter("have < wanted").withColumn("short", F.col("wanted") - F.col("have"))


def fraction(df: DataFrame, by: str, share: float, seed: str, key: str) -> DataFrame:
    """A share of each group, rounded down, one row at least."""
    w = Window.partitionBy(by)
    want = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(share)))
    return df.withColumns({"_want": want, "_nth": F.row_number().over(w.orderBy(*hash_order(seed, key)))}).filter("_nth <= _want").drop("_nth", "_want")


def largest_remainder(counts: DataFrame, group: str, n: int, order: str | None = None) -> DataFrame:
    """Shares ``n`` out over groups (column ``n``) in proportion; left-over seats go to the largest remainders, ties by ``order``."""
    every, rank = Window.partitionBy(), Window.orderBy(F.col("_rest").desc(), F.col(order or group))
    exact = F.lit(n) * F.col("n") / F.sum("n").over(every)
    part = counts.withColumns({"_exact": exact}).withColumns({"_floor": F.floor("_exact"), "_rest": F.col("_exact") - F.floor("_exact")})
    left = F.lit(n) - F.sum("_floor").over(every)
    return part.withColumns({"_left": left, "_nth": F.row_number().over(rank)}).select(group, "n", (F.col("_floor") + (F.col("_nth") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """The rows with their rank from 0 in a total order, by ranges: no task sees more than its range.

    The sorted ranges are checkpointed, so that ranks stay what they are if an executor is lost.
    """
    spark = df.sparkSession
    shared_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_k"))
    before = sizes.select("_part", (F.sum("_k").over(Window.orderBy("_part")) - F.col("_k")).alias("_before"))  # a row for each range
    return ranges.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_id", "_before")


def rank_slices(df: DataFrame, order: list[str], cuts: Mapping[str, tuple[float, float]], label: str = "slice") -> DataFrame:
    """Labels rows by their rank's share of all rows: from int(n * low) up to int(n * high)."""
    n = df.agg(F.count("*").alias("_n"))
    ranked = global_rank(df, order, "_rank").crossJoin(F.broadcast(n))  # n is one row
    of = lambda share: F.floor(F.col("_n") * F.lit(share))
    name = F.coalesce(*[F.when((F.col("_rank") >= of(a)) & (F.col("_rank") < of(b)), F.lit(k)) for k, (a, b) in cuts.items()])
    return ranked.withColumn(label, name).filter(F.col(label).isNotNull()).drop("_rank", "_n")


def repeat_cyclic(df: DataFrame, order: str, n: int, index: str = "anchor_index") -> DataFrame:
    """n rows by going round the table in order."""
    size = df.agg(F.count("*").alias("_size"))
    times = global_rank(df, [order], "_pos").crossJoin(F.broadcast(size))  # size is one row
    copies = F.floor((F.lit(n) - 1 - F.col("_pos")) / F.col("_size"))
    return times.filter(F.col("_pos") < n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), copies))).withColumn(index, (F.col("_pos") + F.col("_k") * F.col("_size")).cast("long")).drop("_pos", "_k", "_size")


def next_rows(df: DataFrame, order: list[str], low: float, n: int) -> DataFrame:
    """n rows from the rank at which the share ``low`` of all rows is reached."""
    size = df.agg(F.count("*").alias("_n"))
    start = F.floor(F.col("_n") * F.lit(low))
    return global_rank(df, order, "_rank").crossJoin(F.broadcast(size)).filter((F.col("_rank") >= start) & (F.col("_rank") < start + n)).drop("_rank", "_n")  # size is one row


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """The rows with running sums of each group before this row, by ranges of the order: a hot group spreads over many tasks.

    Rows are ordered by group, then order; a range knows its own sums, and a table of
    one row for each range and group adds those of the ranges before.
    """
    ranked = global_rank(df.withColumns({f"_x_{k}": c for k, c in sums.items()}), [*group, *order], "_rank")
    part = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    size = max(1, -(-ranked.count() // part))
    placed = ranked.withColumn("_range", F.floor(F.col("_rank") / size))
    own = Window.partitionBy("_range", *group).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range", *group).agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges that the group reaches
    before = totals.select("_range", *[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)], *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    match = F.col("p._range") == F.col("b._range")
    for i, g in enumerate(group):
        match = match & F.col(f"p.{g}").eqNullSafe(F.col(f"b._g_{i}"))
    both = placed.withColumns({f"_o_{k}": F.coalesce(F.sum(f"_x_{k}").over(own), F.lit(0)) for k in sums}).alias("p").join(before.alias("b"), match)
    return both.select(*[F.col(f"p.{c}") for c in df.columns], *[(F.col(f"p._o_{k}") + F.col(f"b._b_{k}")).alias(k) for k in sums])


def expand(df: DataFrame, k: int, name: str = "candidate") -> DataFrame:
    """Each row k times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(k))))


def progress(step: Column, ramp: int) -> Column:
    return F.least(step / F.lit(float(max(ramp - 1, 1))), F.lit(1.0))


def curriculum_weight(level: Column, t: Column) -> Column:
    """From the level itself to 6 less the level, as t goes from 0 to 1."""
    return F.greatest((1 - t) * level + t * (F.lit(6.0) - level), F.lit(1e-6))


def curriculum(items: DataFrame, key: str, level: str, steps: int, per_step: int, seed: str, ramp: int | None = None) -> DataFrame:
    """step, slot and item, drawn with replacement by weights that move from easy to hard levels.

    A level is drawn by the inverse of the levels' cumulative weights, then an item
    within it by its rank, so nothing is crossed but steps and levels. Ranks are made by
    ranges: a level that holds all items is spread over all tasks.
    """
    spark = items.sparkSession
    ranked = running(items.select(F.col(key), F.col(level).alias("_level")).withColumn("_key", hash_key(seed, key)), ["_level"], ["_key", key], {"_rank": F.lit(1).cast("long")}).drop("_key")
    sizes = items.groupBy(F.col(level).alias("_level")).agg(F.count("*").alias("_size"))
    slots = spark.range(steps * per_step).select(F.floor(F.col("id") / per_step).alias("step"), (F.col("id") % per_step).alias("slot"))
    few = sizes.count() <= BROADCAST_LEVELS
    weights = spark.range(steps).select(F.col("id").alias("step")).crossJoin(F.broadcast(sizes) if few else sizes).withColumn("_w", F.col("_size") * curriculum_weight(F.col("_level").cast("double"), progress(F.col("step"), ramp or steps)))
    by = Window.partitionBy("step").orderBy("_level")
    share = weights.withColumns({"_to": F.sum("_w").over(by), "_all": F.sum("_w").over(Window.partitionBy("step"))}).withColumns({"_from": (F.col("_to") - F.col("_w")) / F.col("_all"), "_to": F.col("_to") / F.col("_all")})
    name = F.concat_ws(":", F.lit(seed), "step", "slot")
    drawn = slots.withColumns({"_u": uniform(name), "_v": uniform(F.concat(name, F.lit(":item")))}).join(share, "step").filter("_u >= _from and _u < _to")
    return drawn.withColumn("_rank", F.floor(F.col("_v") * F.col("_size")).cast("long")).join(ranked, ["_level", "_rank"]).select("step", "slot", key, F.col("_level").alias(level))


def with_next(df: DataFrame, group: str, order: str, name: str, none: Column, index: str = "index") -> DataFrame:
    """The rows with their index in their group and the next row's ``order``: an equi-join on group and index, so that a hot group spreads over many tasks."""
    numbered = running(df, [group], [order], {index: F.lit(1).cast("long")})
    after = numbered.select(F.col(group).alias("_group"), (F.col(index) - 1).alias("_index"), F.col(order).alias("_next"))
    return numbered.join(after, F.col(group).eqNullSafe(F.col("_group")) & (F.col(index) == F.col("_index")), "left").withColumn(name, F.coalesce("_next", none)).drop("_group", "_index", "_next")


def mix_streams(steps: DataFrame, step: str, warm_up: int, low: float, high: float, seed: str) -> DataFrame:
    """Tags each step with stream 1 or 2; the share of 2 rises from low to high over the warm-up."""
    t = F.least(F.col(step) / F.lit(float(max(warm_up, 1))), F.lit(1.0))
    share = F.lit(low) + (F.lit(high) - F.lit(low)) * t
    return steps.withColumn("stream", F.when(uniform(F.concat(F.lit(f"{seed}:"), F.col(step).cast("string"))) < share, 2).otherwise(1))


def cyclic_items(mixed: DataFrame, step: str, items: DataFrame, key: str, seed: str) -> DataFrame:
    """The steps of stream 2 with an item each: the items in hash order, again from the first when all have been taken."""
    size = items.agg(F.count("*").alias("_size"))
    second = global_rank(mixed.filter("stream = 2"), [step], "_nth").crossJoin(F.broadcast(size))  # size is one row
    order = global_rank(items.select(key).withColumn("_hash", hash_key(seed, key)), ["_hash", key], "_at")
    return second.withColumn("_at", F.col("_nth") % F.col("_size")).join(order.select("_at", key), "_at").drop("_at", "_nth", "_size")


def shortfall(accepted: Column, cap: Column) -> Column:
    """How many rows are missing to the cap."""
    return F.greatest(cap - accepted, F.lit(0))


def mix_target(cap: Column, anchors: Column, other: Column, preferred: int = 8000, least: int = 1000) -> Column:
    """How many rows a second source may give: what is missing to the preferred size, ``least`` at least, ``cap`` at most."""
    return F.least(cap, F.greatest(F.lit(least), F.lit(preferred) - anchors - other))
