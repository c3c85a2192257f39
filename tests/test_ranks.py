"""Order statistics by pivots and the filtered anti-join, against sorting and the plain join."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import ranks, select

AT = {"low": lambda n: F.lit(0), "median": lambda n: F.floor(n / 2), "p95": lambda n: F.floor((n - 1) * 0.95), "high": lambda n: n - 1}


def plain(xs):
    xs = sorted(xs)
    n = len(xs)
    return n, xs[0], xs[n // 2], xs[int((n - 1) * 0.95)], xs[-1]


def test_order_statistics(spark):
    rnd, rows = random.Random(3), []
    rows += [("a", rnd.gauss(0, 1e3)) for _ in range(4000)] + [("same", 7.0)] * 3000 + [("b", 5.0)] + [("two", float(i % 2)) for i in range(999)] + [(None, float(i)) for i in range(10)] + [("a", None)] + [("skew", 10.0 ** rnd.randint(-9, 9)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    for small in (300, 50_000):
        got = {r[0]: tuple(r[1:]) for r in ranks.order_statistics(df, ["g"], "x", AT, small).collect()}
        assert got == {g: plain([x for h, x in rows if h == g and x is not None]) for g in {r[0] for r in rows}}
    one = ranks.order_statistics(df, [], "x", AT, 100).collect()
    assert [tuple(r) for r in one] == [plain([x for _, x in rows if x is not None])]
    assert ranks.order_statistics(df.limit(0), ["g"], "x", AT).count() == 0


def test_held_out(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id % 1000 END AS k", "id AS _bits", "'x' AS `a.b`")
    for held in ([1, 2, 3, None, 2000], [], list(range(0, 1000, 2))):
        side = spark.createDataFrame([(x,) for x in held], "k long")
        want = sorted(map(repr, df.join(side, "k", "left_anti").collect()))
        for words in (10**6, 0):
            assert sorted(map(repr, ranks.held_out_few(df.withColumnRenamed("_bits", "v"), side, "k", words).withColumnRenamed("v", "_bits").collect())) == want


def test_curriculum_one_level(spark):
    """All items on one level: as many draws as asked for, each an item of it."""
    drawn = select.curriculum(spark.range(300).select("id", F.lit(3).alias("level")), "id", "level", 10, 20, "s")
    assert drawn.count() == 200 and drawn.filter("level <> 3").count() == 0 and drawn.select("id").distinct().count() > 100
