"""Each operator on the inputs that are stated by hand."""

import pytest

from corpusmill.plans import cases
from tests.cases import ROWS


@pytest.mark.parametrize("part", range(5))
def test_rows(spark, part):
    for name in sorted(ROWS)[part::5]:
        case = cases.TABLES[name]
        n = len(cases.names(case.given))
        df = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(ROWS[name])], f"case_id long, {case.given}")
        got = [tuple(r) for r in df.select("case_id", *[c.alias(k) for k, c in case.work(df).items()]).collect()]
        assert sorted(got) == [(i, *r[n:]) for i, r in enumerate(ROWS[name])], name


def test_all_have_both():
    assert set(ROWS) == set(cases.TABLES) == set(cases.TEMPLATES)
