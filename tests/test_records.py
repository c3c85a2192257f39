import pytest
from pyspark.sql import functions as F

from corpusmill.operators import records


def test_pools(spark):
    sources = {
        "math": (("p one two three", r"so \boxed{4}", "Level 2"), "problem string, solution string, level string"),
        "s1k": (("q", "", "trace", "", r"\boxed{5}"), "question string, deepseek_thinking_trajectory string, gemini_thinking_trajectory string, deepseek_attempt string, gemini_attempt string"),
        "numina": (("", None, [("user", "ask"), ("assistant", r"\boxed{6}")], "amc"), "problem string, solution string, messages array<struct<role:string,content:string>>, source string"),
        "stratos": (([("ask",), (r"\boxed{7}",)],), "conversations array<struct<value:string>>"),
        "openr1": (("p", ["g1", "g2"], "8", None), "problem string, generations array<string>, answer string, source string"),
    }
    df = records.union_all(*[records.pool(spark.createDataFrame([row], schema), name) for name, (row, schema) in sources.items()])
    got = {r.source: (r.problem, r.solution, r.answer, r.level) for r in df.collect()}
    assert got == {"math": ("p one two three", r"so \boxed{4}", "4", "Level 2"), "s1k": ("q", "trace", "5", "unknown"), "numina": ("ask", r"\boxed{6}", "6", "amc"), "stratos": ("ask", r"\boxed{7}", "7", "unknown"), "openr1": ("p", "g1", "8", "unknown")}
    assert df.filter(records.pool_is_valid(df)).count() == 0


def test_reasons(spark):
    good = ("q", None, "5", None, None, "step " * 50, "x", False)
    rows = [good, (*good[:5], "short", "x", False), (*good[:7], True), ("中", *good[1:]), ("q", ["a"], "B", "B", None, "step " * 50, "x", True), ("q", None, "", None, "<think>a</think>", "", records.ANCHOR, False), ("q", None, "", None, "none", "", records.ANCHOR, False), (*good[:2], "y" * 80, *good[3:])]
    schema = "question string, options array<string>, answer string, target_answer string, target string, reasoning string, source string, is_mcq boolean"
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(records.record_reason()).collect()]
    assert got == [None, "reasoning_too_short", "non_letter_mcq_target_answer", "chinese_question", None, None, "anchor_bad_think_tag_count", "invalid_answer_field"]


def test_shapes(spark):
    df = spark.createDataFrame([(1, "x [ANS] [ANS]", "a", 0), (2, "complete the table", "b", 4)], "id int, question string, answer string, n_ans int")
    got = records.training_record(df, "s").orderBy("question").collect()
    assert [(r.n_ans, r.is_mcq, r.options) for r in got] == [(4, False, None), (2, False, None)]
    none = F.lit(None).cast("array<string>")
    assert [r[0] for r in df.orderBy("id").select(records.distill_bucket(F.col("question"), none)).collect()] == ["multi", "table_many"]
    assert records.rl_problem(df, F.array("answer")).first().id == "public_1"
    assert records.tagged(df).first().eval_source == "public"
    assert df.select(records.required(df, ["id", "reasoning"])).first()[0] == ["reasoning"]
    g = spark.createDataFrame([("Yes", "no", "t1", "t2"), ("no", " yes", "t1", "t2"), ("", "yes", "t1", "t2")], "deepseek_grade string, gemini_grade string, deepseek_thinking_trajectory string, gemini_thinking_trajectory string")
    assert [(r.t.trace, r.t.origin) for r in g.select(records.graded_trace(g).alias("t")).collect()] == [("t1", "deepseek"), ("t2", "gemini"), (None, "unverified")]


def test_projections(spark):
    step = "step " * 55 + "end."
    verified = spark.createDataFrame([("p", "5", [step, step], [True, True], [True, False])], "problem string, answer string, generations array<string>, is_reasoning_complete array<boolean>, correctness_math_verify array<boolean>")
    instruct = spark.createDataFrame([("Pick (A) one (B) two", "We add. The answer is B.")], "instruction string, output string")
    difficulty = spark.createDataFrame([("q [ANS] [ANS]", "5, 6", step + " more.", None, step)], "question string, final_answer string, r1_solution_1 string, r1_solution_2 string, r1_solution_3 string")
    graded = spark.createDataFrame([("q", "no", "Yes", "t", step, "a", r"\boxed{7}")], "question string, deepseek_grade string, gemini_grade string, deepseek_thinking_trajectory string, gemini_thinking_trajectory string, deepseek_attempt string, gemini_attempt string")
    got = {k: records.projected(df, k).first() for k, df in (("verified", verified), ("instruct", instruct), ("difficulty", difficulty), ("graded", graded))}
    assert (got["verified"].answer, got["verified"].reasoning, got["verified"].is_mcq) == ("5", step, False)
    assert (got["instruct"].options, got["instruct"].answer, got["instruct"].reasoning, got["instruct"].is_mcq) == (["one", "two"], "B", "We add.", True)
    assert (got["difficulty"].n_ans, got["difficulty"].reasoning) == (2, step)
    assert (got["graded"].answer, got["graded"].reasoning) == ("7", step)
    clean = records.projected(spark.createDataFrame([("q", "5", "r", "s")], "question string, answer string, reasoning string, source string"), "clean").first()
    assert (clean.target_answer, clean.original_source, clean.n_ans, clean.is_mcq) == ("5", "s", 1, False)


def test_prompt_prefix(spark):
    df = spark.createDataFrame([("ab", "abc"), ("x", "abc")], "p string, t string")
    assert df.filter("p = 'ab'").select(records.prompt_is_prefix("p", "t")).collect()[0][0] is True
    with pytest.raises(Exception, match="doesn't begin"):
        df.select(records.prompt_is_prefix("p", "t")).collect()
    assert records.anchors(spark.createDataFrame([("s", "b")], "source string, bucket string")).first().asDict() == {"source": "anchor", "bucket": "b", "original_source": "s", "original_bucket": "b"}
