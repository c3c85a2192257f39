"""Verdicts of batches: rows that are the same are judged once, and the queries deal them over all cores."""

import pandas as pd
import pytest

from corpusmill.functions import grading
from corpusmill.plans import cases

SF = "/root/testdata/sf0.001"
KINDS = {"grade_lists": "UOL", "grade_equations": "EQ", "grade_ordered_lists": "OL", "grade_expressions": "EX", "grade_intervals": "INT", "grade_numeric": "NV", "grade_letters": "MCM", "grade_choices": "MCS"}


def counted(monkeypatch, owner, name, by_key=False):
    calls, real = [], owner[name] if by_key else getattr(owner, name)

    def fn(*args, **named):
        calls.append(args)
        return real(*args, **named)

    monkeypatch.setitem(owner, name, fn) if by_key else monkeypatch.setattr(owner, name, fn)
    return calls


PAIRS = {"UOL": ("1, 2", "2, 1"), "EQ": ("x+y=2", "2x+2y=4"), "OL": ("1, 2", "1, 2.0"), "EX": ("x+x", "2x"), "INT": ("(1,2]", "(1, 2.0]"), "NV": ("0.5", "1/2"), "MCM": ("BA", "AB"), "MCS": ("(a)", "A")}


@pytest.mark.parametrize("name", KINDS)
def test_once(spark, monkeypatch, name):
    kind = KINDS[name]
    calls = counted(monkeypatch, grading.METHODS, kind, by_key=True)
    got = grading.of_kind_udf(kind).func(pd.Series([PAIRS[kind][0], "?", PAIRS[kind][0], None] * 50), pd.Series([PAIRS[kind][1]] * 200))
    assert got.tolist() == [True, False, True, False] * 50 and len(calls) == 3
    assert cases.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_plus_minus_once(monkeypatch):
    calls = counted(monkeypatch, grading, "same_list")
    got = grading.same_udf.func(pd.Series([r"\pm 2", r"\pm 3"] * 50), pd.Series(["-2, 2"] * 100))
    assert got.tolist() == [True, False] * 50 and len(calls) == 2


def test_kinds_once(monkeypatch):
    calls = counted(monkeypatch, grading, "judge")
    got = grading.typed_udf().func(pd.Series([r"\boxed{1, BA}", "none"] * 50), pd.Series([["1.0", "AB"], None] * 50), pd.Series([["NV", "MCM"]] * 100))
    assert got.tolist() == [True, False] * 50 and len(calls) == 2
