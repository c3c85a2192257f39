"""What a text goes through is worked out once a row, by as many tasks as there are cores."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.plans import cases

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    """The plan, in which each place that works something out is written."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clean_traces(spark):
    texts = spark.createDataFrame([("step " * 60 + "done.",)], "t string").repartition(2)
    assert optimized(texts.select(T.clean_trace("t").alias("c"))).count("</?think>") == 1
    df = cases.QUERIES["clean_traces"](spark, SF)
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_shortest_traces(spark):
    assert optimized(cases.QUERIES["shortest_traces"](spark, SF)).count("</?think>") == 1


def test_verified_generations(spark):
    df = cases.QUERIES["verified_generations"](spark, SF)
    assert optimized(df).count("</?think>") == 1
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_cut_at_noise(spark):
    df = spark.createDataFrame([("w" * 120 + " the answer is 3",), ("short",), (None,)], "t string").repartition(2)
    assert optimized(df.select(T.cut_at_noise("t").alias("c"))).count("lower(") == 1
    assert [r[0] for r in df.select(T.cut_at_noise("t")).orderBy(F.length("t").desc_nulls_last()).collect()] == ["w" * 120, "short", None]
