import pytest
from pyspark.sql import functions as F

from corpusmill.operators import link, reward, rules, select, stats


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(i, "ab"[i % 2], i * 10) for i in range(10)] + [(10, None, None)], "id long, g string, v long")


def test_rules(t):
    rs = [rules.Rule("none", F.col("v").isNull()), rules.Rule("big", F.col("v") > 50), rules.Rule("huge", F.col("v") > 70)]
    assert rows(rules.histogram(rules.apply(t, rs))) == [("big", 4), ("none", 1), (None, 6)]
    assert rows(rules.audit(t, rs, "id", 2)) == [("big", 4, "6,7"), ("huge", 2, "8,9"), ("none", 1, "10")]
    assert tuple(rules.gate(t, rs).first()) == (11, 5, False) and tuple(rules.gate(t, rs[:0] or [rules.Rule("x", F.lit(None).cast("boolean"))]).first())[2]
    assert rules.kept(rules.apply(t, rs)).count() == 6
    capped = rules.capped(rules.apply(t.filter("g is not null"), rs), "reason", "g", "id", 2, "s")
    assert capped.filter("reason is null").count() == 4


def test_selection(spark, t):
    assert select.sample(t, 3, "s", "id").count() == 3 and select.sample(t, 99, "s", "id").count() == 11
    assert rows(select.cap_per_group(t, ["g"], 2, "s", "id").groupBy("g").count()) == [("a", 2), ("b", 2), (None, 1)]
    assert rows(select.quotas(t, "g", {"a": 2, "b": 99, "z": 1}, "s", "id").groupBy("g").count()) == [("a", 2), ("b", 5)]
    assert rows(select.fraction(t, "g", 0.1, "s", "id").groupBy("g").count()) == [("a", 1), ("b", 1), (None, 1)]
    counts = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "g string, n long")
    assert rows(select.largest_remainder(counts, "g", 4)) == [("x", 1, 2), ("y", 1, 1), ("z", 1, 1)]
    assert rows(select.rank_slices(t.select("id"), ["id"], {"low": (0, 0.4), "mid": (0.4, 0.9)}).groupBy("slice").count()) == [("low", 4), ("mid", 5)]
    assert [r.rank for r in select.global_rank(t, ["id"]).orderBy("id").collect()] == list(range(11))
    got = select.repeat_cyclic(spark.range(3), "id", 7)
    assert rows(got.select("anchor_index", "id")) == [(i, i % 3) for i in range(7)]
    assert select.repeat_cyclic(spark.range(5), "id", 2).count() == 2
    drawn = select.curriculum(spark.range(50).select("id", (F.col("id") % 5 + 1).alias("level")), "id", "level", 40, 10, "s")
    assert drawn.count() == 400
    early, late = (drawn.filter(c).agg(F.avg("level")).first()[0] for c in ("step < 10", "step >= 30"))
    assert early > late


def test_links(t):
    held = t.filter("id < 3").select("id")
    assert link.held_out(t, held, "id").count() == 8
    have, left = link.resume(t.select("id"), t.filter("id > 7"), "id")
    assert (have.count(), left.count()) == (3, 8)
    over = link.overlay(t.select("id", "v"), t.filter("id = 1").select("id", F.lit(7).cast("long").alias("v")), "id", "v")
    assert over.count() == 11 and over.filter("id = 1").first().v == 7
    assert rows(link.duplicates(t, ["g"])) == [("a", 5), ("b", 5)]
    with pytest.raises(ValueError):
        link.lookup_all(t, held, "id")


def test_stats(spark, t):
    assert rows(stats.index_stats(t.filter("g is not null"), ["g"], "v")) == [("a", 5, 0, 40, 60, 80), ("b", 5, 10, 50, 70, 90)]
    assert rows(stats.interpolated(spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "g string, v long"), ["g"], "v")) == [("a", 2, 1, 2.0), ("b", 1, 7, 7.0)]
    e = spark.createDataFrame([(True, True, False, 3, True)], "correct boolean, is_mcq boolean, is_multi boolean, words int, format_ok boolean")
    m = e.agg(*stats.eval_metrics()).first()
    assert (m.n, m.accuracy, m.mcq_accuracy, m.multi_accuracy) == (1, 1.0, 1.0, None)
    m = e.filter("words > 9").agg(*stats.eval_metrics()).first()
    assert (m.n, m.accuracy, m.mcq_accuracy) == (0, 0.0, None)
    split = stats.overlapping_splits(e, {"mcq": F.col("is_mcq"), "none": F.lit(False)})
    assert rows(split) == [("mcq", 1, 1, 1.0), ("none", 0, 0, 0.0)]
    levels = {5.0: 5, 5.5: 4, 6.0: 3, 6.5: None, 7.0: 2, 7.5: 2, 8.5: None, 9.0: 1, 10.0: 1}
    df = spark.createDataFrame([(k,) for k in levels], "d double")
    assert {r.d: r.l for r in df.select("d", stats.difficulty_level(F.col("d")).alias("l")).collect()} == levels


def test_rewards(spark):
    cases = [(r"t</think>\boxed{5}", True, 1.0), (r"t</think>\boxed{5}", False, 0.1), (r"\boxed{5}", True, 0.5), (r"\boxed{} \boxed{5}", True, 0.7), (r"\boxed{} \boxed{5}", False, -0.3), (r"\boxed{}", True, -0.3), ("none", False, -0.2), ("none" * 7000, False, -0.45)]
    df = spark.createDataFrame([(t, c, 1, False) for t, c, _ in cases], "completion string, correct boolean, n int, o boolean")
    assert [r.reward for r in reward.reward(df, "completion", "correct", "n", "o").collect()] == [x for *_, x in cases]
    steps = spark.createDataFrame([(i, 0.5 + (0.1 if i == 3 else 0)) for i in range(20)], "step long, mean double")
    got = {r.step: r.flat for r in reward.flat(steps, "step", "mean").collect()}
    assert not got[7] and not got[11] and got[12] and got[19]
