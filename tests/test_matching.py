"""Matchings of unordered lists against all permutations."""

import itertools
import random

from corpusmill.operators import matching


def largest(xs, ys, same):
    small, big, turn = (xs, ys, False) if len(xs) <= len(ys) else (ys, xs, True)
    return max((sum(same(b, a) if turn else same(a, b) for a, b in zip(small, p, strict=False)) for p in itertools.permutations(big, len(small))), default=0)


def test_against_permutations(spark):
    rnd, left, right, want = random.Random(2), [], [], {}
    same = lambda x, y: abs(x - y) <= max(0.1, 0.05 * abs(y))
    for g in range(60):
        xs = [round(rnd.uniform(0, 1.2), 2) for _ in range(rnd.randint(0, 6))]
        ys = [round(rnd.uniform(0, 1.2), 2) for _ in range(rnd.randint(0, 6))]
        left += [(g, i, x) for i, x in enumerate(xs)]
        right += [(g, i, y) for i, y in enumerate(ys)]
        if xs or ys:
            want[g] = (len(xs), len(ys), largest(xs, ys, same))
    left, right = spark.createDataFrame(left, "g long, l long, x double").repartition(3), spark.createDataFrame(right, "g long, r long, y double").repartition(2)
    got = {r.g: r for r in matching.same_lists(left, right, matching.edges_within(left, right, 0.1, 0.05)).collect()}
    assert {g: (r.n_left, r.n_right, r.n_matched) for g, r in got.items()} == want
    assert all(r.same == (r.n_left == r.n_right == r.n_matched) for r in got.values())


def test_any_order(spark):
    """Four numbers of which neighbours are the same: the verdict is the same for every order of the parts."""
    xs, ys = [3.5, 3.4, 3.6, 3.45], [3.45, 3.55, 3.5, 3.4]
    orders = list(itertools.permutations(range(4)))
    left = spark.createDataFrame([(g, i, xs[k]) for g, o in enumerate(orders) for i, k in enumerate(o)], "g long, l long, x double")
    right = spark.createDataFrame([(g, i, y) for g in range(len(orders)) for i, y in enumerate(ys)], "g long, r long, y double")
    out = matching.same_lists(left, right, matching.edges_within(left, right, 0.06, 0.0)).collect()
    assert len(out) == 24 and {(r.n_matched, r.same) for r in out} == {(4, True)}


def test_long_paths(spark):
    """A chain whose only full matching turns every edge that a greedy choice takes."""
    n = 12
    edges = [(1, i, i) for i in range(n)] + [(1, i, i - 1) for i in range(1, n)] + [(2, 0, 0), (2, 1, 0), (3, 0, None)]
    df = spark.createDataFrame([e for e in edges if e[2] is not None], "g long, l long, r long").union(spark.createDataFrame([(1, 0, 0)], "g long, l long, r long"))
    got = matching.maximum_matching(df).collect()
    assert sorted(r.l for r in got if r.g == 1) == sorted(r.r for r in got if r.g == 1) == list(range(n)) and sum(r.g == 2 for r in got) == 1


def test_odd(spark):
    none = spark.createDataFrame([], "g long, l long, r long")
    assert matching.maximum_matching(none).count() == 0
    left, right = spark.createDataFrame([(1, 0, None), (1, 1, -5.0), (2, 0, 0.0)], "g long, l long, x double"), spark.createDataFrame([(1, 0, None), (1, 1, -5.01), (2, 0, 0.0), (3, 0, 1.0)], "g long, r long, y double")
    got = {r.g: (r.n_left, r.n_right, r.n_matched, r.same) for r in matching.same_lists(left, right, matching.edges_within(left, right, 0.0, 0.01)).collect()}
    assert got == {1: (2, 2, 1, False), 2: (1, 1, 1, True), 3: (0, 1, 0, False)}


def test_same_numbers(spark):
    """One row a group, and the rounds for the groups that are too large for it, against all permutations; no rounds without such groups."""
    rnd, left, right, want = random.Random(5), [(90, 0, None), (90, 1, float("nan")), (91, 0, float("inf")), (None, 0, 1.0)], [(90, 0, None), (90, 1, 2.0), (91, 0, float("inf")), (None, 0, 1.0)], {90: (2, 2, 0), 91: (1, 1, 0)}
    for g in range(60):
        xs, ys = ([round(rnd.uniform(0, 1.2), 2) for _ in range(rnd.randint(0, 6))] for _ in range(2))
        left += [(g, i, x) for i, x in enumerate(xs)]
        right += [(g, i, y) for i, y in enumerate(ys)]
        if xs or ys:
            want[g] = (len(xs), len(ys), largest(xs, ys, lambda x, y: abs(x - y) <= 0.1))
    left, right = spark.createDataFrame(left, "g long, l long, x double").repartition(3), spark.createDataFrame(right, "g long, r long, y double").repartition(2)
    for row_parts in (8, 1000):
        rows = matching.same_numbers(left, right, 0.1, row_parts).collect()
        assert {r.g: (r.n_left, r.n_right, r.n_matched) for r in rows if r.g is not None} == want
        assert sorted((r.n_left, r.n_right, r.same) for r in rows if r.g is None) == [(0, 1, False), (1, 0, False)]
        assert all(r.same == (r.n_left == r.n_right == r.n_matched) for r in rows)
    plan = matching.same_numbers(left, right, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
