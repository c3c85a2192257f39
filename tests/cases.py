"""Inputs and what must come of them, stated by hand: by the query's name in ``corpusmill/plans/cases.py``."""

from corpusmill.functions import text as T

_T, _N = True, False
_THREE = ["red", "$blue$.", r"\text{green}"]
_STEP = "step "

ROWS = {
    "grade_numeric": [
        ("3.0", "3", _T, _T), ("2/4", "0.5", _T, _T), (r"\frac{3}{4}", "0.75", _T, _T), (r"\frac12", "1/2", _T, _T), ("3.004", "3", _N, _N), ("0", "0.0", _T, _T), ("0.001", "0", _N, _N), ("1,234", "1234", _T, _T), ("-5", "5", _N, _N),
        ("-5", "-5.00", _T, _T), (".5", "0.5", _T, _T), ("007", "7", _T, _T), ("50%", "50", _T, _T), (r"2\pi", "6.283185307179586", _T, _T), (r"\sqrt{16}", "4", _T, _T), ("2^5", "32", _T, _T), ("1e3", "1000", _T, _T), ("x", "7", _N, _N),
        (r"3.5 \times 10^{4}", "35000", _T, _T), ("3.45*10^4", r"3.5 \times 10^{4}", _T, _T), ("3.7*10^4", "3.5*10^4", _N, _N), ("3.5*10^5", "3.5*10^4", _N, _N), ("100000000", "100000001", _T, _T), ("10000", "10001", _N, _N), ("", "4", _N, _N),
    ],
    "grade_expressions": [
        ("x^2+2x+1", "(x+1)^2", _T, _T), (r"\sin(x)^2+\cos(x)^2", "1", _T, _T), ("2ab", "2ba", _T, _T), ("x+1", "x+2", _N, _N), (r"\frac{x}{y}", "x/y", _T, _T), ("xy", "x*y", _T, _T), (r"\sqrt{x^2}", "x", _T, _T), ("x^2", "x^3", _N, _N),
        ("ln(x)", "log(x)", _N, _N), ("a+b", "b+a", _T, _T), ("2(x+3)", "2x+6", _T, _T), ("x-(y-z)", "x-y-z", _N, _N),
    ],
    "grade_equations": [
        ("2x+2y=4", "x+y=2", _T, _T), ("x+y=2", "2x+2y=4", _T, _T), ("x+y=2", "x+y=3", _N, _N), ("3y=6x-9", "y-2x+3=0", _T, _T), ("2x+2y=4", "3x+3y=6", _N, _N), ("x^2+y^2=1", "1=x^2+y^2", _T, _T), ("y=2x+1", "2x+1=y", _T, _T), ("x^2+y^2=1", "y^2=1-x^2", _T, _T), ("x+y=2", "x+y", _N, _N),
    ],
    "grade_intervals": [
        ("(1, 2]", "(1,2.0]", _T, _T), ("(1,2)", "(1,2]", _N, _N), (r"(-\infty, 3)", "(-∞,3)", _T, _T), (r"(0,1)\cup(2,3]", r"(2,3] \cup (0,1)", _T, _T), (r"(0,1)\cup(2,3)", "(0,1)", _N, _N), ("[1/2,1]", "[0.5,1]", _T, _T), ("[0,1)", "[0,2)", _N, _N),
    ],
    "grade_lists": [
        ("3, 1, 2", "1,2,3", _T, _T), ("1,2", "1,3", _N, _N), ("1,2", "1,2,3", _N, _N), ("1,1,2", "1,2,2", _N, _N), (r"\{1, 2\}", "2,1", _T, _T), (r"\{1,1,2\}", "1,2", _T, _T), ("1 or 2", "2, 1", _T, _T), ("0.5, x+x", "2x, 1/2", _T, _T), ("(3,4)", "(3, 4.0)", _T, _T),
    ],
    "grade_ordered_lists": [("1,2,3", "1, 2, 3.0", _T, _T), ("3,2,1", "1,2,3", _N, _T), ("1,2", "1,2,3", _N, _N), ("(a+b, 2)", "(b+a, 2)", _T, _T)],
    "grade_choices": [("A", "A", _T, _T), ("(c)", "C", _T, _T), ("A: red", "A", _T, _T), ("B", "A", _N, _N), ("apple", "A", _N, _N), ("[D]", "D", _T, _T), ("AB", "A", _N, _N)],
    "grade_letters": [("BA", "AB", _T, _T), ("A, B", "AB", _T, _T), ("A", "AB", _N, _N), ("ABC", "AB", _N, _N), ("ACB", "ABC", _T, _T)],
    "grade_truth": [("yes", "True", _T, _T), ("False", "true", _N, _N), ("incorrect", "No", _T, _T), ("right", "correct", _T, _T), ("maybe", "True", _N, _N)],
    "grade_text": [("Paris", "paris", _T, _T), ("Mon", "Monday", _T, _T), ("New  York", "new york", _T, _T), (r"\text{blue}", "Blue", _T, _T), ("red", "blue", _N, _N), ("", "", _T, _T), ("twelve", "12", _T, _T), (None, "x", _N, _N)],
    "grade_plus_minus": [(r"\pm 3", "-3, 3", _T), (r"2 \pm \sqrt{3}", r"2+\sqrt{3}, 2-\sqrt{3}", _T), (r"x = 1 \pm 2", "3, -1", _T), (r"\pm 3", "3", _N), (r"1 \pm 1", "0, 3", _N), ("±4", r"\pm 4", _T)],
    "grade_normalised": [
        ("$5$", "5"), (r"\text{red} car", "red car"), (r"\left( 3 \right)", "3"), (r"\dfrac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\sqrt3", r"\sqrt{3}"), ("x = 4", "4"), ("a = b = 7", "7"), ("5 cm", "5"), ("3 hours", "3"), (r"90^\circ", "90"),
        (".25", "0.25"), ("2.00", "2"), ("1.50", "1.50"), ("0042", "42"), ("Tues", "tuesday"), ("Seven", "7"), ("quarter", "1/4"), ("((8))", "8"), ("(1, 2)", "(1, 2)"), (": 6.", "6"), ("1,234,567", "1234567"), ("12,34", "12,34"), (r"f(x) = x^2", "x^2"), (None, ""), (r"2 \times 3", "2 * 3"), ("30%", "30"),
    ],
    "extracted_answers": [
        (r"<think>\boxed{1}</think> so \boxed{2}", "2", "2"), (r"\boxed{1}, \boxed{2}", "1, 2", "1, 2"), (r"\boxed{1} but no: \boxed{2}", "2", "2"), (r"<think>\boxed{9}</think> done", "9", "9"), ("work\n#### 42\nend", "42", "42"), ("The answer is 12.", "12", "12"),
        ("Answer: $x+1$", "x+1", "x+1"), ("Therefore 17 is the answer", "17", "17"), ("Hence 4 is our answer.", "Hence 4", "Hence 4"), ("we get $y^2$ here", "y^2", ""), ("it has 3 apples and 14 pears", "14", ""), ("nothing", "", ""), (None, "", ""),
    ],
    "judged_responses": [
        (r"<think>a</think>\boxed{5}", ["5"], None, _T, "strict_correct"), (r"\boxed{5}", ["6"], None, _N, "unrescued"), (r"a \boxed{1} then words \boxed{2}", ["1", "2"], None, _T, "multi_box_join"), (r"\boxed{1}, \boxed{2}", ["1", "2"], None, _T, "strict_correct"),
        (r"so \boxed[9.001]", ["9"], None, _T, "boxed_syntax"), (r"\boxed{0.333}", ["1/3"], None, _T, "exact_decimal_numeric"), (r"\boxed{4} is it, not \boxed{7}", ["4"], None, _T, "exact_decimal_numeric"), (r"\boxed{x} is it, not \boxed{7}", ["x"], None, _T, "judger_lenient"),
        (r"\boxed{red}", ["A"], _THREE, _T, "mcq_value_match"), (r"\boxed{B}", ["B"], _THREE, _T, "strict_correct"), (r"\boxed[C]", ["C"], _THREE, _T, "boxed_syntax"), (r"\boxed{B} or \boxed{A}", ["B"], _THREE, _T, "mcq_letter_recovered"), ("I take option (b)", ["B"], _THREE, _T, "prose_fallback"),
        (r"\boxed{blue}", ["C"], _THREE, _N, "unrescued"), ("The answer is 3.14. Done", ["3.1416"], None, _T, "prose_fallback"), ("y = 5\nnext 7", ["5"], None, _T, "prose_fallback"), ("", ["1"], None, _N, "unrescued"), (None, ["1"], None, _N, "unrescued"), (r"\boxed{1}", [], None, _N, "unrescued"),
    ],
    "judged_by_kind": [
        (r"\boxed{3, AB}", ["3.0", "BA"], ["NV", "MCM"], _T), (r"\boxed{3, AB}", ["3.0", "BA"], ["NV", "MCS"], _N), (r"\boxed{(1,2]}", ["(1,2]"], ["INT"], _T), (r"\boxed{x+x}", ["2x"], ["EX"], _T), (r"\boxed{x+x}", ["2x"], ["OE"], _N), (r"\boxed{3}", ["3", "4"], ["NV", "NV"], _N), (r"\boxed{yes}", ["True"], ["TF"], _T),
    ],
    "lenient_numbers": [("1,000", "1001", _T, _N), ("3.004", "3", _T, _N), ("3.2", "3", _N, _N), ("0.004", "0", _T, _N), ("x", "3", None, _N), ("X y", "xY", None, _T), ("200", "202", _T, _N), ("200", "203", _N, _N)],
    "lenient_parts": [("1.001, b", ["1", "B"], _T), ("1, 2", ["1"], _N), ("1, 2", ["2", "1"], _N), (r"\frac{1}{3}, x", ["0.3333", "x"], _T), ("", [], _T), ("5", ["7"], _N)],
    "boxed_extract": [
        (r"so \boxed{\frac{1}{2}} or \boxed{ a{b{c}} } then \boxed{open {x}", 2, r"\frac{1}{2}|a{b{c}}", r"\frac{1}{2}"), (r"\boxed{}", 1, "", ""), ("none", 0, "", ""), (r"\boxed {7}", 1, "7", ""), (r"\boxed{1}\boxed{2}", 2, "1|2", "1|2"), (r"\boxed{\boxed{3}}", 1, r"\boxed{3}", r"\boxed{3}"), (r"\boxed{open \boxed{4}", 1, "4", "4"), (None, 0, "", ""),
    ],
    "split_commas": [
        ('(1, 2], {a, b}, "x, y", 7, , z\\, w', 5, '(1, 2]|{a, b}|"x, y"|7|z\\, w', '(1|2]|{a|b}|"x|y"|7|z\\|w'), ("", 0, "", ""), ("a", 1, "a", "a"), (", ,", 0, "", ""), ("(1, 2)", 1, "(1, 2)", "(1, 2)"), ("f(x, g(y, z)), b", 2, "f(x, g(y, z))|b", "f(x|g(y|z))|b"), (None, 0, "", None),
    ],
    "box_repair": [
        (r"First \boxed{x} and \boxed{{y}}", "First x and {y}", r"First \boxed{x} and", "x|{y}"), (r"\boxed{1} so then \boxed{2} end", "1 so then 2 end", r"\boxed{1} so then \boxed{2} end", "2"), (r"\boxed{a \boxed{b}}", "a b", "", r"a \boxed{b}"), (r"open \boxed{x", r"open \boxed{x", r"open \boxed{x", ""), ("plain", "plain", "plain", ""), (None, "", "", ""),
    ],
    "last_box_command": [(r"a \boxed{1} b \fbox{2} c", r"\fbox{2}", "2"), (r"\fbox{1} \boxed{\frac{1}{2}}", r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{open", None, None), ("none", None, None), (None, None, None)],
    "option_parsing": [
        ("Answer Choices: (A) one 1 (B) two (C) three", "B", "ABC", "one 1", _T, _T), ("(A) x (C) y", "7", "AC", "x", _N, _N), ("What is 2+2?", "4", "", None, _N, _N), ("Pick: A) one B) two C) three", "x", "", None, _N, _T), ("Which of the following holds?", "x", "", None, _N, _T), ("Solve it", "(D)", "", None, _N, _T), ("(A) only", "1", "A", "only", _N, _N),
    ],
    "labelled_options": [
        ("a ) 12 , b ) 13 , c ) none", "12|13|none", _N, ""), ("A. red\nB. blue\nC. green", "A. red\nB. blue\nC. green", _T, "A=red;B=blue;C=green"), ("A) x\nB) y", "A) x\nB) y", _N, "A=x;B=y"), ("A. one\nB. two\nC. three\nA. four", "A. one\nB. two\nC. three\nA. four", _T, "A=four;B=two;C=three"), ("no options", "no options", _N, ""),
    ],
    "mcq_letters": [
        (r"not E. </think> \boxed{(B)}", "Blue", "B", "B", "A. red\nB. $blue$.\nC. \\text{green}"), ("A or B? It is C.", "c)", "C", None, "A. red\nB. $blue$.\nC. \\text{green}"), ("no letter", "(A)", None, "A", "A. red\nB. $blue$.\nC. \\text{green}"), (r"\boxed{d}", "green", "D", "C", "A. red\nB. $blue$.\nC. \\text{green}"), ("DATA", "purple", None, None, "A. red\nB. $blue$.\nC. \\text{green}"),
    ],
    "candidates": [
        ("The answer is 42. So x = 7.\n", "prose_fallback=42|prose_fallback=7|prose_fallback=x = 7"), (r"\boxed{5}", "boxed_last=5"), (r"\boxed{1} \boxed{2}", "boxed_last=2|multi_box_join=1, 2|boxed_each=1|boxed_each=2"), ("the final answer: $x+1$", "prose_fallback=x+1|prose_fallback=the final answer: $x+1"), ("I pick option C here, which is long enough to be no final clause of its own because it goes on for more than one hundred and twenty characters", "prose_fallback=C"), ("Therefore, 9.", "prose_fallback=9"), ("</think>Hence it is 12", "prose_fallback=it is 12"), ("answer is 3.5 exactly\nanswer: 3.5 exactly", "prose_fallback=3.5 exactly|prose_fallback=answer is 3.5 exactly\nanswer: 3.5 exactly"),
    ],
    "native_candidates": [
        ("The answer is 42. So x = 7.\n", 3, "prose_fallback=42|prose_fallback=7|prose_fallback=x = 7"), (r"\boxed{5}", 1, "boxed_last=5"), (r"\boxed{1} \boxed{2}", 4, "boxed_last=2|multi_box_join=1, 2|boxed_each=1|boxed_each=2"), ("choice (b) it is, and on it goes at such length that there is no last clause which could be taken for an answer of one hundred and twenty characters", 1, "prose_fallback=B"),
    ],
    "repaired_answers": [
        (r"x</think>\boxed{1}", 1, _N, "1", _T), (r"x</think>\boxed{1, 2}", 2, _N, "1, 2", _T), (r"x</think>\boxed{1, 2}", 3, _N, "1, 2", _N), (r"\boxed{1} \boxed{2} \boxed{3}", 2, _N, "2, 3", _N), (r"</think>\boxed{B}", 1, _T, "B", _T), (r"</think>\boxed{red}", 1, _T, None, _N), ("first\nlast line\n", 1, _N, "last line", _N),
    ],
    "final_answers": [("  5 .", "5", None), (r"so \boxed{a b}", "a b", None), ("", None, "empty_answer"), ("答案是五", None, "chinese_answer"), ("y" * 241, None, "answer_too_long"), ("y" * 240, "y" * 240, None), ("line\none", "line one", None)],
    "render_targets": [
        (" why 5 ", r"\boxed{5}", "<think>\nwhy 5\n</think>\n\n\\boxed{5}", None), ("", "7", f"<think>\n{T.DEFAULT_REASONING}\n</think>\n\n\\boxed{{7}}", None), (None, " x ", f"<think>\n{T.DEFAULT_REASONING}\n</think>\n\n\\boxed{{x}}", None), (r"has \boxed{1}", "2", "<think>\nhas \\boxed{1}\n</think>\n\n\\boxed{2}", "bad_box_count"), ("a </think> b", "2", "<think>\na </think> b\n</think>\n\n\\boxed{2}", "bad_think_count"),
    ],
    "think_parts": [("<think> a b </think> c", "a b", " c", "a b", "<think> a b </think> c"), ("a</think>b", None, "b", "a", "a</think>b"), ("plain", None, "plain", "plain", "plain"), ("<think>x</think>", "x", "", "x", "x"), (None, None, None, None, None)],
    "abrupt_tails": [
        ("the sum is 12", _N, _N, _N), ("and so we", _T, _N, _N), ("which means that therefore,", _T, _N, _N), ("that would mean ...", _T, _N, _N), ("it is so。", _T, _N, _N), ("print(x)", _N, _T, _N), ("In summary, it holds", _N, _N, _T), ("", _T, _N, _N), ("hold on!", _T, _N, _N), ("use the method", _T, _N, _N), ("```python", _N, _T, _N), ("```py", _N, _N, _N), ("a band", _N, _N, _N),
    ],
    "cut_at_noise": [
        ("a" * 100 + " **Final answer:** 5", "a" * 100 + " **", "final answer:"), ("in summary " + "a" * 100 + " in summary b", "in summary " + "a" * 100, "in summary"), ("f" * 100 + " **Conclusion** : x", "f" * 100, None), ("in summary " + "b" * 120, "in summary " + "b" * 120, "in summary"), ("c" * 120, "c" * 120, None), ("d" * 110 + " the answer is 4. In summary", "d" * 110, "the answer is"), ("e" * 101 + " knowledge point then", "e" * 101, "knowledge point"),
    ],
    "clean_traces": [
        (_STEP * 60 + "done.", 61, None, None), (_STEP * 10, None, "too_short", None), ("<think>" + _STEP * 50 + "end.</think>", 51, None, None), ("", None, "empty_reasoning", None), (_STEP * 60 + "In summary it is", None, "noise_phrase", "in summary"), (_STEP * 60 + "so", None, "abrupt_tail", None), (_STEP * 60 + "步", None, "chinese_characters", None), (_STEP * 60 + r"\boxed{4} end.", 62, None, None), (_STEP * 60 + r"\boxed{4 end.", None, "boxed_remains", None),
    ],
    "answer_tails": [
        ("We add both. The final answer is 12.", "We add both."), ("We add both.\n\nFinal Answer: \\boxed{3}", "We add both.\n\nFinal"), ("Therefore, the answer is x.", ""), ("It is 4 apples.", "It is 4 apples."), ("So we see. Thus, the correct answer is B", "So we see."), (None, None),
    ],
    "stage0_texts": [
        ("Add. This confirms the requested value. Stop", "Add. Stop"), ("So 5. The computation also checks the ordering requested.", "So 5. The final answer is listed in order."), ("The requested sum is 5", "The required sum is 5"), ("a  b\n\n\n\nc ", "a b\n\nc"), (None, None),
        ("x The computation also checks the ordering requested, which is enough to identify the requested result. y", "x The final answer is listed in the required order. y"),
    ],
    "letter_sentences": [("Add them. Therefore, the answer is (B).", "Add them."), ("Add. Answer: C", "Add."), ("The answer is 12", "The answer is 12"), ("So the correct answer is D.", "")],
    "shortest_traces": [([_STEP * 60 + "done.", _STEP * 52 + "end."], 53), ([_STEP * 10], None), ([], None), ([_STEP * 60 + "so", _STEP * 70 + "end."], 71), ([_STEP * 55 + "a.", _STEP * 55 + "b."], 56)],
    "small_texts": [
        ("a  b\t c\n\n\n\nd", "a b c\n\nd", "a  b\t c\n\n\n\nd", "abcd", "a  b\t c\n\n\n\nd", 0, "a  b\t c\n\n\n\nd"), (r" \text{Red} . ", r" \text{Red} . ", "Red .", "red", r" \text{red} . ", 0, "Red"), ("Level 3", "Level 3", "Level 3", "level3", "level 3", 3, "Level 3"), ("*(B)*", "*(B)*", "*(B)*", "*(b)*", "(b)", 0, "*(B)*"), ("(B)", "(B)", "(B)", "(b)", "(b)", 0, "B"),
    ],
    "distill_buckets": [
        ("[ANS]", 0, "single", "single", "Give one value in the box."), ("[ANS] [ANS]", 0, "multi", "multi", "Give all values in the box, in order, with commas between them."), ("[ANS] " * 5, 0, "table_many", "multi", "Fill every blank of the table, in order, with commas between them."), ("pick one", 8, "mcq10", "mcq", "Give the letter of one option in the box."), ("pick one", 4, None, "mcq", None), ("Complete the table below", 0, "table_many", "single", "Fill every blank of the table, in order, with commas between them."), ("no blank", 0, None, "single", None),
    ],
    "answer_rules": [("5", "", "not_a_letter"), ("", "empty_answer", "not_a_letter"), (None, "empty_answer", "not_a_letter"), ("y" * 50, "answer_too_long", "not_a_letter"), ("y" * 49, "", "not_a_letter"), ("a\nb", "answer_has_newline", "not_a_letter"), ("B", "", None)],
    "target_reasons": [
        ("What is it?", _STEP * 50, "5", None), (" ", _STEP * 50, "5", "empty_question"), ("什么", _STEP * 50, "5", "chinese_question"), ("Pick one", _STEP * 50, "(B)", "mcq_like"), ("What?", _STEP * 50 + "步", "5", "chinese_rendered_target"), ("What?", _STEP * 50 + "<think>", "5", "bad_think_tag_count"),
        ("What?", _STEP * 50 + r"\boxed{5}", "5", "bad_boxed_structure"), ("What?", _STEP * 49, "5", "reasoning_too_short"), ("What?", _STEP * 50 + r"\boxed", "5", "boxed_in_reasoning"), (None, None, None, "empty_question"),
    ],
    "length_classes": [(0, "easy"), (499, "easy"), (500, "medium"), (1499, "medium"), (1500, "hard")],
    "reward_contract": [("2+2?", "4", "4", 1.0), ("2+2?", "5", "4", 0.0), ("x", "", "", 1.0), ("x", "y", None, 0.0)],
    "verified_generations": [
        ([_STEP * 60 + "a.", _STEP * 55 + "b."], [_T, _T], [_T, _T], 2, _STEP * 55 + "b."), ([_STEP * 60 + "a.", _STEP * 55 + "b."], [_T, _N], [_T, _T], 1, _STEP * 60 + "a."), ([_STEP * 60 + "a.", _STEP * 55 + "b."], [_T], [_T, _T], 1, _STEP * 60 + "a."), (["short"], [_T], [_T], 1, None), ([], [], [], 0, None), ([_STEP * 60 + "a."], None, [_T], 0, None),
    ],
    "numeric_thresholds": [("5", None), ("4.9", "below_threshold"), ("x", "bad_value"), (None, "bad_value"), ("1_000", "bad_value"), (" 7 ", None), ("-3", "below_threshold")],
    "source_rules": [("openr1", None, _N), ("blocked_set", "blocked_source", _N), ("other", "disallowed_source", _N), (None, "disallowed_source", _N), ("aime_24", "disallowed_source", _T), ("AoPS_forum", "disallowed_source", _T)],
    "reward_table": [
        (r"t</think>\boxed{5}", _T, 1, _N, "ideal_box", 1.0), (r"t</think>\boxed{5}", _N, 1, _N, "ideal_box", 0.1), (r"\boxed{5}", _T, 1, _N, "usable_bad_format", 0.5), (r"\boxed{5}", _N, 1, _N, "usable_bad_format", 0.0), (r"\boxed{} and \boxed{5}", _T, 1, _N, "scattered_box", 0.7), (r"\boxed{}", _N, 1, _N, "no_usable_box", -0.3), ("none", _T, 1, _N, "no_usable_box", 0.3), ("none", _N, 1, _N, "no_usable_box", -0.2),
        (r"t</think>\boxed{1, 2}", _T, 2, _N, "ideal_box", 1.0), (r"t</think>\boxed{1, 2}", _N, 2, _N, "ideal_box", 0.2), (r"t</think>\boxed{1}", _N, 2, _N, "ideal_box", -0.05), (r"t</think>\boxed{B}", _N, 1, _T, "ideal_box", 0.13), (r"t</think>\boxed{red}", _N, 1, _T, "ideal_box", 0.05), (r"\boxed{} \boxed{x}", _N, 1, _T, "scattered_box", -0.35), ("word " * 5000 + r"</think>\boxed{5}", _T, 1, _N, "ideal_box", 0.75),
    ],
    "array_pieces": [
        (["a", "b", "c"], ["1", "2", "3"], "a1|b2|c3", "c", "a|b", "b2"), (["a", "b", "c"], ["1"], "a1", "c", "a|b", None), ([], ["1"], "", None, "", None), (["b", "b"], ["1", "2"], "b1|b2", "b", "b|b", "b2"), (None, ["1"], "", None, None, None),
    ],
    "label_masks": [([1, 2, 3, 4], 2, 6, "-100,-100,3,4,-100,-100", _T), ([1, 2], 2, 2, "-100,-100", _T), ([1, 2, 3], 0, 3, "1,2,3", _T), ([1, 2], 3, 4, "-100,-100,-100,-100", _N)],
    "nested_responses": [('{"choices": [{"message": {"content": "hi"}}]}', "hi", "hi"), ('{"choices": []}', None, "none"), ("not json", None, "none"), (None, None, "none"), ('{"choices": [{"message": {"content": "a"}}, {"message": {"content": "b"}}]}', "a", "a")],
    "coalesced": [("x", "y", "z", "x", "x"), ("", "y", "z", "y", ""), (None, "", "z", "z", ""), (None, None, None, "", None), ("", "", "", "", "")],
    "file_names": [("out/data.jsonl", "out/data.manifest.json", "out/data.jsonl", "data"), ("a/stage_records.jsonl", "a/stage_manifest.json", "a/stage-records.jsonl", "stage_records"), ("My_Pkg>=2.1", "My_Pkg>=2.1.manifest.json", "my-pkg", "My_Pkg>=2"), ("torch==2.3", "torch==2.3.manifest.json", "torch", "torch==2")],
    "stage_ladder": [
        ("math", "Level 1", 10, 1), ("math", "Level 3", 10, 2), ("math", "Level 4", 10, 3), ("math", "Level 5", 10, 4), ("math", None, 10, 1), ("numina", "synthetic_math", 10, 1), ("numina", "math", 10, 2), ("numina", "synthetic_amc", 10, 2), ("numina", "aops_forum", 10, 3), ("numina", "amc_aime", 10, 4), ("numina", "olympiads", 10, 4),
        ("numina", "other", 149, 1), ("numina", "other", 150, 2), ("numina", "other", 799, 3), ("numina", "other", 800, 4), ("stratos", None, 100, 5), ("openr1", None, 1001, 4), ("openr1", None, 1000, 3), ("s1k", None, 10, 4), ("other", None, 10, 2),
    ],
    "difficulty_levels": [(10.0, 1), (9.0, 1), (8.5, None), (8.0, 2), (7.5, 2), (6.0, 3), (6.5, None), (5.5, 4), (5.0, 5), (4.0, None), (None, None)],
    "shortfalls": [(5, 10, 1000, 6500, 5, 10), (12, 10, 1000, 6500, 0, 10), (0, 6500, 872, 1500, 6500, 5628), (0, 2000, 7000, 900, 2000, 1000)],
}
