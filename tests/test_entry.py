import __spark_entry__ as entry


def test_catalogue(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0
    for name in ("word_stats_by_source", "capped_mix", "curriculum_sample", "stream_resume"):
        assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
