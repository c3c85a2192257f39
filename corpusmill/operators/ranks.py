"""Exact order statistics of groups of any size, by pivots: no task sees more than its share of a group.

Equal values are counted first. A round splits the interval that holds a wanted rank at about
``PIVOTS`` approximate quantiles of its distinct values, counts the rows between them exactly, and
goes on with the part that holds the rank. An interval of ``SMALL`` values is sorted; one of a
single value is done. Rounds grow with the logarithm of the distinct values, and after the
first each reads only the parts that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir

PIVOTS, SMALL = 63, 50_000
#: Rows of targets that are broadcast at most.
BROADCAST_ROWS = 100_000


def _kept(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def order_statistics(df: DataFrame, by: list[str], x: str, at: Mapping[str, Callable[[Column], Column]], small: int = SMALL) -> DataFrame:
    """For each group n and the values at ranks (from 0) of its sorted values; ``at`` gives a rank from n. Nulls are left out; a rank out of bounds is the nearest one."""
    rows = _kept(df.select(*by, F.col(x).alias("_x")).filter("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("_c")))
    sizes = _kept(rows.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max")))
    kind = rows.schema["_x"].dataType
    bounded = lambda f: F.greatest(F.lit(0), F.least(f(F.col("n")).cast("long"), F.col("n") - 1))
    targets = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), bounded(f).alias("rank")) for k, f in at.items()])).alias("t"), F.lit(None).cast(kind).alias("lo"), F.col("_max").alias("hi")).select(*by, "t.name", "t.rank", "lo", "hi")
    targets, found = _kept(targets), []
    keys = [*by, "lo", "hi"]
    same = lambda a, b: reduce(lambda p, q: p & q, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    few = targets.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else lambda d: d  # targets only get fewer
    live = rows.withColumns({"lo": F.lit(None).cast(kind)}).join(hint(sizes.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_max").alias("hi"))), reduce(lambda p, q: p & q, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True))).drop(*[f"_{b}" for b in by])
    while True:
        stats = _kept(live.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", [i / (PIVOTS + 1) for i in range(1, PIVOTS + 1)], 1000).alias("_p")).withColumn("_p", F.array_sort(F.array_distinct("_p"))))
        done = live.alias("r").join(hint(stats.filter(F.col("_n") <= small)).alias("s"), same("r", "s"), "left_semi")
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x"))  # ``small`` rows at most
        found.append(targets.alias("t").join(done.withColumn("_upto", upto).alias("s"), same("t", "s") & (F.col("t.rank") < F.col("s._upto")) & (F.col("t.rank") >= F.col("s._upto") - F.col("s._c"))).select(*[f"t.{b}" for b in by], "t.name", F.col("s._x").alias("value")))
        large = stats.filter(F.col("_n") > small)
        if large.isEmpty():
            break
        place = F.size(F.filter("_p", lambda p: p < F.col("_x")))
        split = live.alias("r").join(hint(large).alias("s"), same("r", "s")).select(*[F.col(f"r.{k}") for k in keys], F.col("r._x").alias("_x"), F.col("r._c").alias("_c"), F.col("s._p").alias("_p")).withColumn("_b", place)
        counts = split.groupBy(*keys, "_b").agg(F.sum("_c").alias("_k"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
        w = Window.partitionBy(*keys).orderBy("_b")  # a row for each pivot
        parts = _kept(counts.withColumn("_before", F.sum("_k").over(w) - F.col("_k")))
        hit = targets.alias("t").join(parts.alias("s"), same("t", "s") & (F.col("t.rank") >= F.col("s._before")) & (F.col("t.rank") < F.col("s._before") + F.col("s._k")))
        hit = _kept(hit.select(*[F.col(f"t.{b}") for b in by], "t.name", (F.col("t.rank") - F.col("s._before")).alias("rank"), F.col("t.lo").alias("_lo"), F.col("t.hi").alias("_hi"), F.col("s._from").alias("lo"), F.col("s._to").alias("hi")))
        found.append(hit.filter("lo = hi").select(*by, "name", F.col("lo").alias("value")))
        targets = hit.filter("lo < hi").select(*by, "name", "rank", "lo", "hi")
        inside = hit.filter("lo < hi").select(*[F.col(b).alias(f"_{b}") for b in by], F.col("lo").alias("_from"), F.col("hi").alias("_to")).distinct()
        match = reduce(lambda p, q: p & q, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True)) & (F.col("_x") >= F.col("_from")) & (F.col("_x") <= F.col("_to"))
        if targets.isEmpty():
            break
        live = _kept(live.drop("lo", "hi").join(hint(inside), match).select(*by, "_x", "_c", F.col("_from").alias("lo"), F.col("_to").alias("hi")))
    values = reduce(DataFrame.unionByName, found).groupBy(*by).pivot("name", list(at)).agg(F.first("value"))
    return sizes.select(*by, "n").alias("n").join(values.alias("v"), reduce(lambda p, q: p & q, [F.col(f"n.{b}").eqNullSafe(F.col(f"v.{b}")) for b in by], F.lit(True)), "left").select(*[f"n.{b}" for b in by], "n.n", *[f"v.{k}" for k in at])


#: Words of a filter that are broadcast at most (16 bytes each), bits for each key, bits that a key sets.
FILTER_WORDS, KEY_BITS, HASHES = 4_000_000, 16, 4


def _mask(key: str) -> Column:
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(64)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(1, HASHES + 1)])


def held_out_few(df: DataFrame, held: DataFrame, key: str, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose key isn't held out (a null one isn't), where most rows stay: only those that a Bloom filter can't rule out are shuffled.

    The filter is a table of 64-bit words, sized by the number of held-out keys: a key sets a few
    bits of one word. It is broadcast if it has at most ``filter_words`` words; beyond that the
    plain anti-join does it all.
    """
    keys = held.select(key).filter(F.col(key).isNotNull()).distinct()
    words = max(1, keys.count() * KEY_BITS // 64)
    if words > filter_words:
        return df.join(keys, key, "left_anti")
    word = F.pmod(F.xxhash64(F.lit(0), key), F.lit(words))
    bits = keys.groupBy(word.alias("_word")).agg(F.bit_or(_mask(key)).alias("_bits"))  # at most ``words`` rows
    probed = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(_mask(key)) == _mask(key), F.lit(False)) & F.col(key).isNotNull()
    sure, doubt = (probed.filter(test).select(*[f"`{c}`" for c in df.columns]) for test in (~maybe, maybe))
    return sure.unionByName(doubt.join(keys, key, "left_anti").select(*[f"`{c}`" for c in df.columns]))
