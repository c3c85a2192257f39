"""Queries of comparisons in columns: their rows go to all cores, also from a file that one task reads."""

from corpusmill.plans import comparison

SF = "/root/testdata/sf0.001"


def test_equal_expressions(spark):
    assert comparison.QUERIES["equal_expressions"](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_equal_equations(spark):
    assert comparison.QUERIES["equal_equations"](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
