import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import grading, scan, tokens
from corpusmill.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_boxes():
    assert scan.boxes(r"a \boxed{\frac{1}{2}} b \boxed{ x } \boxed{open") == [r"\frac{1}{2}", "x"]
    assert scan.boxes(None) == []
    assert scan.last_boxes(r"\boxed{0} then \boxed{1}, \boxed{2} and \boxed{3}.") == ["1", "2", "3"]
    assert scan.unbox(r"\boxed{a\boxed{b}} \boxed{c") == r"ab \boxed{c"
    assert scan.drop_last_box("x \\boxed{1} \n") == "x" and scan.drop_last_box(r"\boxed{1} y") == r"\boxed{1} y"
    assert scan.split_commas(r'(1, 2], {a, b}, "x, y",, z\, w') == ["(1, 2]", "{a, b}", '"x, y"', r"z\, w"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}ab\\", max_size=30))
def test_boxes_balance(t):
    for b in scan.boxes("\\boxed{" + t + "}"):
        assert b.count("{") == b.count("}")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("0.5", r"\frac{1}{2}", True), ("1,000", "1000", True), ("x^2-1", "(x-1)(x+1)", True), ("(1,2]", "(1, 2.0]", True), ("(1,2]", "(1,2)", False), ("2,1", "1,2", True), (r"\sqrt{8}", r"2\sqrt{2}", True), ("y=2x+1", "2x+1=y", True),
        ("0", "0.0", True), ("1e-9", "0", True), ("3", "4", False), ("Yes", "true", True), ("no", "true", False), ("a+b", "b+a", True), ("xy", "yx", True), (r"\text{Mon}", "Monday", True), ("", "1", False), ("1", "1,2", False), ("three", "3", True), ("(-1,1)\\cup(2,3)", "(2,3)\\cup(-1,1)", True), ("1/0", "1", False),
        ("((((", "1", False), ("x=5", "5", True),
    ],
)
def test_same(a, b, same):
    assert grading.same(a, b) is same


def test_judge():
    assert grading.judge(r"<think>\boxed{9}</think> \boxed{2, 3}", ["2", "3"])
    assert not grading.judge(r"\boxed{2, 4}", ["2", "3"])  # all parts are compared
    assert not grading.judge(r"\boxed{2}", ["2", "3"]) and not grading.judge(r"\boxed{2}", [])
    assert grading.judge(r"\boxed{(B)}", ["B"], ["x", "y"]) and not grading.judge(r"\boxed{A}", ["B"], ["x", "y"])
    assert grading.judge("work\n#### 42", ["42"]) and grading.judge("The answer is 7.", ["7"])
    assert grading.score("thus x = 7.", ["7"]) == (True, "strict_correct")  # the last number is the answer where nothing else is
    assert grading.score("thus x = 7.\nNext 9", ["7"]) == (True, "prose_fallback")
    assert grading.score("It must be option B", ["B"], ["p", "q"]) == (True, "prose_fallback")
    assert grading.score("It must be B", ["B"], ["p", "q"]) == (False, "unrescued")  # a sentence is no label
    assert grading.score(r"\boxed{3.142}", [r"\pi"]) == (True, "exact_decimal_numeric")
    assert grading.score("no idea", ["7"]) == (False, "unrescued")


def test_text_columns(spark):
    assert one(spark, T.falsy_coalesce("x", F.lit("d")), "") == "d"
    assert one(spark, T.unwrap("x"), r" \text{yes} ") == "yes"
    assert one(spark, T.collapse_space("x"), "a \t b\n\n\n\nc") == "a b\n\nc"
    assert one(spark, T.earliest("x", ["b", "a"])["phrase"], "xxab") == "a"
    assert one(spark, T.cut_at_noise("x"), "w" * 120 + " the answer is 3") == "w" * 120
    assert one(spark, T.cut_at_noise("x"), "short. the answer is 3") == "short. the answer is 3"
    assert one(spark, T.ends_abruptly("x"), "so we get...") and one(spark, T.ends_abruptly("x"), "and therefore,") and not one(spark, T.ends_abruptly("x"), "it is done.")
    assert one(spark, T.think_block("x"), "<think> a </think> b") == "a" and one(spark, T.think_block("x"), "b") is None
    assert one(spark, T.level_number("x"), "Level 4") == 4 and one(spark, T.level_number("x"), "?") == 0
    assert one(spark, T.last_line("x"), "a\n b \n \n") == "b" and one(spark, T.last_line("x"), "\n") is None
    assert one(spark, T.split_flat("x"), "(1, 2)") == ["(1, 2)"] and one(spark, T.split_flat("x"), "1,,2 ") == ["1", "2"]
    assert one(spark, T.mcq_letter("x"), "A? B. </think> So C or (D)") == "D" and one(spark, T.mcq_letter("x"), "none") is None
    assert one(spark, T.embedded_mcq("x"), "q\nA. x\nB) y\n(C) z") and not one(spark, T.embedded_mcq("x"), "A. x\nB. y")
    assert one(spark, T.labels_continuous("x"), ["A", "B", "D"], "array<string>") is False
    assert one(spark, T.canonical_choice("x", F.array(F.lit("red"), F.lit("Blue."))), "blue") == "B"
    assert one(spark, T.final_answer("x")["reason"], " . ") == "empty_answer" and one(spark, T.final_answer("x")["answer"], r"so \boxed{5}") == "5"
    assert one(spark, T.final_answer("x")["reason"], "y" * 241) == "answer_too_long" and one(spark, T.final_answer("x")["answer"], "y" * 240) == "y" * 240
    assert one(spark, T.clean_trace("x")["reason"], "step " * 49 + "end") is None and one(spark, T.clean_trace("x")["reason"], "step " * 48 + "end") == "too_short"
    assert one(spark, T.shortest_clean("x", 2), ["a b c.", "d e.", None, "f g."], "array<string>") == "d e."
    assert [tuple(r) for r in one(spark, T.answer_candidates("x"), r"\boxed{1} \boxed{2}")][:2] == [("boxed_last", "2"), ("multi_box_join", "1, 2")]
    assert one(spark, T.format_ok("x", F.lit(2), F.lit(None).cast("array<string>")), r"</think>\boxed{1,2}") and not one(spark, T.format_ok("x", F.lit(1), F.lit(None).cast("array<string>")), r"\boxed{1}\boxed{2}")
    assert one(spark, T.user_problem("x", F.lit(None).cast("array<string>")), " q ") == "q"


def test_rows_end_in_time():
    """A row that takes too long keeps its strict verdict; boxes that never close take linear time."""
    assert grading.score(r"\boxed{x}", ["x+1"], seconds=-1.0) == (False, "timeout")
    assert grading.score(r"\boxed{x}", ["x"], correct=True) == (True, "strict_correct")
    assert scan.box_spans(r"\boxed{" * 100_000) == []
    assert len(scan.box_spans(r"\boxed{x}" * 50_000)) == 50_000


def test_token_counts(spark):
    path = "/opt/tokenizers/word_bpe_49k.json"
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    texts = ["plain words here", "", None, "naïve 12345"]
    with open(path) as f:
        content = f.read()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(tokens.token_count_udf(content)("t")).collect()]
    own = tokenizers.Tokenizer.from_str(content)
    assert got == [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
