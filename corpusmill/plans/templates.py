"""Texts made from the numbers and names of ``part``, with what must come out of them as SQL of the same columns.

A template stands for one form of input; row k of the table takes the one whose place is
k modulo their number. ``«x»`` in a text is a SQL expression of the columns of ``NUMBERS``; a
text that begins with ``=`` is one altogether, and so are numbers and truth values. Expressions
are those that both engines read.
"""

from __future__ import annotations

import re

NUMBERS = {
    "k": "p_partkey", "a": "CAST(p_size AS BIGINT)", "b": "p_partkey % 11 - 5", "e": "CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END", "nm": "p_name", "br": "p_brand",
    "l": "substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1)", "l2": "substr('BCDA', CAST(p_partkey % 4 AS INT) + 1, 1)",
}
SQL = {"string": "VARCHAR", "boolean": "BOOLEAN", "long": "BIGINT", "double": "DOUBLE"}

_S50, _S60, _S10 = "«repeat('step ', 50)»", "«repeat('step ', 60)»", "«repeat('step ', 10)»"
_YES = "=CASE WHEN b < 0 THEN '%s' ELSE '%s' END"
_OPTIONS = ["red«k»", "blue«k»", "green«k»", "grey«k»"]
_BLOCK = "A. red\nB. $blue$.\nC. \\text{green}"
_STEPS = "Give all values in the box, in order, with commas between them."
_REASON = "Work through the problem and give the result."


def _both(rows: list[tuple]) -> list[tuple]:
    """Pairs that every kind of comparison sees as the one named does."""
    return [(*r, r[-1]) for r in rows]


TEMPLATES: dict[str, list[tuple]] = {
    "grade_numeric": _both([("«a».0", "«a»", True), ("«2*a»/4", r"\frac{«a»}{2}", True), ("«a»", "«a+e»", "e = 0"), ("-«a»", "«a»", False), (r"\sqrt{«a*a»}", "«a»", True), ("«a»%", "«a»", True), ("«a»e3", "«a*1000»", True), ("0«a»", "«a».00", True), ("«nm»", "«a»", False)]),
    "grade_expressions": _both([("(x+«a»)^2", "x^2+«2*a»x+«a*a»", True), ("x+«a»", "x+«a+e»", "e = 0"), ("«a»ab", "«a»ba", True), ("«a»(x+3)", "«a»x+«3*a»", True), ("x^«a+1»", "x^«a+2»", False), (r"\frac{x}{«a+1»}", "x/«a+1»", True)]),
    "grade_equations": _both([("«a»x+«a»y=«4*a»", "x+y=4", True), ("x+y=«a»", "x+y=«a+e»", "e = 0"), ("y=«a»x+1", "«a»x+1=y", True)]),
    "grade_intervals": _both([("(«a», «a+2»]", "(«a»,«a+2».0]", True), ("(«a»,«a+2»)", "(«a»,«a+2»]", False), (r"(-\infty, «a»)", "(-∞,«a»)", True), (r"(0,1)\cup(2,«a+3»]", r"(2,«a+3»] \cup (0,1)", True), ("[0,«a»)", "[0,«a+e»)", "e = 0")]),
    "grade_lists": _both([("«a», 1, 2", "1,2,«a»", True), ("«a», 100", "«a», «100+e»", "e = 0"), ("«a», «a+1»", "«a», «a+1», «a+2»", False), (r"\{«a», 200\}", "200, «a»", True), ("«a» or 200", "200, «a»", True)]),
    "grade_ordered_lists": [("«a»,2,3", "«a», 2, 3.0", True, True), ("3,2,«a+5»", "«a+5»,2,3", False, True), ("«a»,«a+1»", "«a»,«a+1»,«a+2»", False, False)],
    "grade_choices": _both([("«l»", "«l»", True), ("(«lower(l)»)", "«l»", True), ("«l»: «nm»", "«l»", True), ("«l2»", "«l»", False), ("«nm»", "«l»", False), ("[«l»]", "«l»", True)]),
    "grade_letters": _both([("«l2»«l»", "«l»«l2»", True), ("«l», «l2»", "«l»«l2»", True), ("«l»", "«l»«l2»", False), ("«l»«l2»Z", "«l»«l2»", False)]),
    "grade_truth": _both([(_YES % ("yes", "no"), "True", "b < 0"), (_YES % ("incorrect", "right"), "No", "b < 0"), ("«nm»", "True", False)]),
    "grade_text": _both([("«upper(nm)»", "«nm»", True), ("«nm»", "«br»", False), (r"\text{«nm»}", "«nm»", True), ("«replace(nm, ' ', '  ')»", "«nm»", True)]),
    "grade_plus_minus": [(r"\pm «a»", "-«a», «a»", True), (r"2 \pm \sqrt{«a+2»}", r"2+\sqrt{«a+2»}, 2-\sqrt{«a+2»}", True), (r"\pm «a»", "«a»", False), (r"x = «a» \pm 2", "«a+2», «a-2»", True), (r"1 \pm «a»", "0, 300", False)],
    "grade_normalised": [("$«a»$", "«a»"), (r"\text{«nm»}", "«nm»"), (r"\left( «a» \right)", "«a»"), (r"\sqrt«k%9+1»", r"\sqrt{«k%9+1»}"), ("x = «a»", "«a»"), ("«a» cm", "«a»"), (r"«a»^\circ", "«a»"), ("«a».00", "«a»"), ("00«a»", "«a»"), ("((«a»))", "«a»"), (": «a».", "«a»"), ("«a»,000,000", "«a»000000")],
    "extracted_answers": [
        (r"<think>\boxed{«b+6»}</think> so \boxed{«a»}", "«a»", "«a»"), (r"\boxed{«a»}, \boxed{«k»}", "«a», «k»", "«a», «k»"), (r"\boxed{«k»} but no: \boxed{«a»}", "«a»", "«a»"), ("work\n#### «a»\nend", "«a»", "«a»"), ("The answer is «a».", "«a»", "«a»"),
        ("Answer: $x+«a»$", "x+«a»", "x+«a»"), ("we get $y^«a»$ here", "y^«a»", ""), ("it has 3 «nm» and «a» pears", "«a»", ""), ("«nm»", "", ""),
    ],
    "judged_responses": [
        (r"<think>a</think>\boxed{«a»}", ["«a»"], None, True, "strict_correct"), (r"\boxed{«a»}", ["«a+1»"], None, False, "unrescued"), (r"a \boxed{«a»} then words \boxed{«k»}", ["«a»", "«k»"], None, True, "multi_box_join"), (r"\boxed{«l»}", ["«l»"], _OPTIONS, True, "strict_correct"),
        (r"\boxed{red«k»}", ["A"], _OPTIONS, True, "mcq_value_match"), (r"\boxed[«l»]", ["«l»"], _OPTIONS, True, "boxed_syntax"), ("The answer is «a».14. Done", ["«a».1416"], None, True, "prose_fallback"),
    ],
    "judged_by_kind": [
        (r"\boxed{«a», «l»«l2»}", ["«a».0", "«l2»«l»"], ["NV", "MCM"], True), (r"\boxed{«a», «l»«l2»}", ["«a».0", "«l2»«l»"], ["NV", "MCS"], False), (r"\boxed{(1,«a+2»]}", ["(1,«a+2»]"], ["INT"], True), (r"\boxed{x+«a»x}", ["«a+1»x"], ["EX"], True),
        (r"\boxed{x+«a»x}", ["«a+1»x"], ["OE"], False), (r"\boxed{«a»}", ["«a»", "4"], ["NV", "NV"], False),
    ],
    "lenient_numbers": [("«a*1000»", "«a*1000+1»", True, False), ("«a».004", "«a»", True, False), ("«a».9", "«a-3»", False, False), ("x", "«a»", None, False), ("X «a»", "x«a»", None, True), ("«a»", "«a»", True, True)],
    "lenient_parts": [("«a».001, «br»", ["«a»", "«lower(br)»"], True), ("«a», 2", ["«a»"], False), ("«a»", ["«a+1»"], False)],
    "boxed_extract": [(r"so \boxed{\frac{«a»}{2}} or \boxed{ «nm»{b{c}} } then \boxed{open {x}", 2, r"\frac{«a»}{2}|«nm»{b{c}}", r"\frac{«a»}{2}"), (r"\boxed{}«k»", 1, "", ""), ("«nm»", 0, "", ""), (r"\boxed {«a»}", 1, "«a»", ""), (r"\boxed{«a»}\boxed{«k»}", 2, "«a»|«k»", "«a»|«k»")],
    "split_commas": [('(«a», 2], {«nm», b}, "x, y", 7, , z\\, w', 5, '(«a», 2]|{«nm», b}|"x, y"|7|z\\, w', '(«a»|2]|{«nm»|b}|"x|y"|7|z\\|w'), ("", 0, "", ""), ("«nm»", 1, "«nm»", "«nm»"), ("(«a», «k»)", 1, "(«a», «k»)", "(«a», «k»)")],
    "box_repair": [(r"First \boxed{«a»} and \boxed{{«k»}}", "First «a» and {«k»}", r"First \boxed{«a»} and", "«a»|{«k»}"), (r"\boxed{«a»} so then \boxed{«k»} end", "«a» so then «k» end", r"\boxed{«a»} so then \boxed{«k»} end", "«k»"), (r"\boxed{a \boxed{«k»}}", "a «k»", "", r"a \boxed{«k»}")],
    "last_box_command": [(r"a \boxed{«a»} b \fbox{«k»} c", r"\fbox{«k»}", "«k»"), (r"\fbox{1} \boxed{\frac{«a»}{2}}", r"\boxed{\frac{«a»}{2}}", r"\frac{«a»}{2}"), (r"\boxed{open «k»", None, None), ("«nm»", None, None)],
    "option_parsing": [
        ("Answer Choices: (A) «a» 1 (B) two (C) three", "B", "ABC", "«a» 1", True, True), ("(A) «a» (C) y", "7", "AC", "«a»", False, False), ("What is «a»+2?", "4", "", None, False, False), ("Solve «nm»", "(D)", "", None, False, True), ("Which of the following holds for «k»?", "x", "", None, False, True),
        ("(A) «nm»", "1", "A", "«nm»", False, False),
    ],
    "labelled_options": [("a ) «a» , b ) «k» , c ) none", "«a»|«k»|none", False, ""), ("A. red«k»\nB. blue\nC. green", "A. red«k»\nB. blue\nC. green", True, "A=red«k»;B=blue;C=green"), ("A) «a»\nB) y", "A) «a»\nB) y", False, "A=«a»;B=y"), ("no «nm»", "no «nm»", False, "")],
    "mcq_letters": [(r"not E. </think> \boxed{(«l»)}", "Blue", "«l»", "B", _BLOCK), ("A or B? It is «l».", "c)", "«l»", None, _BLOCK), ("no «lower(nm)»", "(«l»)", None, "«l»", _BLOCK), (r"\boxed{«lower(l)»}", "green", "«l»", "C", _BLOCK)],
    "candidates": [("The answer is «a». So x = «k+100».\n", "prose_fallback=«a»|prose_fallback=«k+100»|prose_fallback=x = «k+100»"), (r"\boxed{«a»}", "boxed_last=«a»"), (r"\boxed{«a»} \boxed{«k»}", "boxed_last=«k»|multi_box_join=«a», «k»|boxed_each=«a»|boxed_each=«k»")],
    "native_candidates": [("The answer is «a». So x = «k+100».\n", 3, "prose_fallback=«a»|prose_fallback=«k+100»|prose_fallback=x = «k+100»"), (r"\boxed{«a»}", 1, "boxed_last=«a»"), (r"\boxed{«a»} \boxed{«k»}", 4, "boxed_last=«k»|multi_box_join=«a», «k»|boxed_each=«a»|boxed_each=«k»")],
    "repaired_answers": [
        (r"x</think>\boxed{«a»}", 1, False, "«a»", True), (r"x</think>\boxed{«a», «k»}", 2, False, "«a», «k»", True), (r"x</think>\boxed{«a», «k»}", 3, False, "«a», «k»", False), (r"\boxed{1} \boxed{«a»} \boxed{«k»}", 2, False, "«a», «k»", False), (r"</think>\boxed{«l»}", 1, True, "«l»", True),
        (r"</think>\boxed{red}", 1, True, None, False), ("first\n«nm»\n", 1, False, "«nm»", False),
    ],
    "final_answers": [("  «a» .", "«a»", None), (r"so \boxed{«nm»}", "«nm»", None), ("", None, "empty_answer"), ("答案是«a»", None, "chinese_answer"), ("«repeat('y', CAST(240 + e AS INT))»", "=CASE WHEN e = 0 THEN repeat('y', 240) END", "=CASE WHEN e = 1 THEN 'answer_too_long' END"), ("line\n«nm»", "line «nm»", None)],
    "render_targets": [(" why «a» ", r"\boxed{«k»}", "<think>\nwhy «a»\n</think>\n\n\\boxed{«k»}", None), ("", "«a»", f"<think>\n{_REASON}\n</think>\n\n\\boxed{{«a»}}", None), (r"has \boxed{«a»}", "«k»", "<think>\nhas \\boxed{«a»}\n</think>\n\n\\boxed{«k»}", "bad_box_count")],
    "think_parts": [("<think> «nm» b </think> «a»", "«nm» b", " «a»", "«nm» b", "<think> «nm» b </think> «a»"), ("«nm»</think>«a»", None, "«a»", "«nm»", "«nm»</think>«a»"), ("«nm»", None, "«nm»", "«nm»", "«nm»"), ("<think>«a»</think>", "«a»", "", "«a»", "«a»")],
    "abrupt_tails": [("the sum is «a»", False, False, False), ("«nm» and so we", True, False, False), ("which means that «a» therefore,", True, False, False), ("print(«a»)", False, True, False), ("In summary, «nm» holds", False, False, True), ("«a» would mean ...", True, False, False)],
    "cut_at_noise": [("«repeat('a', 100)» **Final answer:** «a»", "«repeat('a', 100)» **", "final answer:"), ("«repeat('c', 120)»«k»", "«repeat('c', 120)»«k»", None), ("in summary «repeat('a', 100)» in summary «k»", "in summary «repeat('a', 100)»", "in summary"), ("«repeat('d', CAST(110 + a AS INT))» the answer is «k». In summary", "«repeat('d', CAST(110 + a AS INT))»", "the answer is")],
    "clean_traces": [
        ("«repeat('step ', CAST(50 + a AS INT))»done.", "51 + a", None, None), ("«repeat('step ', CAST(10 + k % 30 AS INT))»", None, "too_short", None), (_S60 + "In summary it is «a»", None, "noise_phrase", "in summary"), (_S60 + "so", None, "abrupt_tail", None), ("", None, "empty_reasoning", None),
        (_S60 + r"\boxed{«a»} end.", 62, None, None), (_S60 + "步«a»", None, "chinese_characters", None),
    ],
    "answer_tails": [("We add «nm». The final answer is «a».", "We add «nm»."), ("Therefore, the answer is «a».", ""), ("It is «a» apples.", "It is «a» apples."), ("So we see «nm». Thus, the correct answer is «l»", "So we see «nm»."), ("«nm» it is. Answer: «a»", "«nm» it is.")],
    "stage0_texts": [("Add «nm». This confirms the requested value. Stop", "Add «nm». Stop"), ("So «a». The computation also checks the ordering requested.", "So «a». The final answer is listed in order."), ("The requested sum is «a»", "The required sum is «a»"), ("a  «nm»\n\n\n\nc ", "a «nm»\n\nc")],
    "letter_sentences": [("Add «nm». Therefore, the answer is («l»).", "Add «nm»."), ("Add. Answer: «l»", "Add."), ("The answer is «a»", "The answer is «a»"), ("So the correct answer is «l».", "")],
    "shortest_traces": [([_S60 + "done.", "«repeat('step ', CAST(51 + k % 9 AS INT))»end."], "52 + k % 9"), ([_S10 + "«k»"], None)],
    "small_texts": [("a  b\t «k»", "a b «k»", "a  b\t «k»", "ab«k»", "a  b\t «k»", "k", "a  b\t «k»"), ("(«l»)", "(«l»)", "(«l»)", "(«lower(l)»)", "(«lower(l)»)", 0, "«l»")],
    "distill_buckets": [("«nm» [ANS]", 0, "single", "single", "Give one value in the box."), ("[ANS] «nm» [ANS]", 0, "multi", "multi", _STEPS), ("pick one of «k»", 8, "mcq10", "mcq", "Give the letter of one option in the box."), ("pick one of «k»", 4, None, "mcq", None), ("no «nm»", 0, None, "single", None)],
    "answer_rules": [("«a»", "", "not_a_letter"), ("", "empty_answer", "not_a_letter"), ("«l»", "", None), ("«repeat('y', CAST(49 + e AS INT))»", "=CASE WHEN e = 1 THEN 'answer_too_long' ELSE '' END", "not_a_letter"), ("«a»\n«k»", "answer_has_newline", "not_a_letter")],
    "target_reasons": [("What is «a»?", _S50, "«k»", None), (" ", _S50, "«a»", "empty_question"), ("Pick one of «nm»", _S50, "(«l»)", "mcq_like"), ("What is «a»?", "«repeat('step ', CAST(50 - e AS INT))»", "5", "=CASE WHEN e = 1 THEN 'reasoning_too_short' END"), ("What is «nm»?", _S50 + "<think>", "«a»", "bad_think_tag_count")],
    "length_classes": [("CAST(k AS INT)", "=CASE WHEN k < 500 THEN 'easy' WHEN k < 1500 THEN 'medium' ELSE 'hard' END")],
    "reward_contract": [("«nm»?", "«a»", "«a+e»", "CASE WHEN e = 0 THEN 1.0 ELSE 0.0 END"), ("«nm»?", "", "", 1.0), ("«nm»?", "«a»", None, 0.0)],
    "verified_generations": [([_S60 + "a.", "«repeat('step ', 55)»b«k»."], ["true", "b < 0"], ["true", "true"], "CASE WHEN b < 0 THEN 2 ELSE 1 END", "=CASE WHEN b < 0 THEN concat(repeat('step ', 55), 'b', k, '.') ELSE concat(repeat('step ', 60), 'a.') END")],
    "numeric_thresholds": [("«a»", "=CASE WHEN a < 5 THEN 'below_threshold' END"), ("«nm»", "bad_value"), (None, "bad_value"), ("-«k+1»", "below_threshold")],
    "source_rules": [(_YES % ("openr1", "blocked_set"), "=CASE WHEN b >= 0 THEN 'blocked_source' END", False), ("aime_«k»", "disallowed_source", True), ("«nm»", "disallowed_source", False)],
    "reward_table": [
        (r"t</think>\boxed{«a»}", "b < 0", 1, False, "ideal_box", "CASE WHEN b < 0 THEN 1.0 ELSE 0.1 END"), (r"\boxed{«a»}", "b < 0", 1, False, "usable_bad_format", "CASE WHEN b < 0 THEN 0.5 ELSE 0.0 END"),
        (r"t</think>\boxed{«a», «k»}", "b < 0", 2, False, "ideal_box", "CASE WHEN b < 0 THEN 1.0 ELSE 0.2 END"), (r"t</think>\boxed{«l»}", False, 1, True, "ideal_box", 0.13), ("«repeat('word ', 5000)»</think>\\boxed{«a»}", True, 1, False, "ideal_box", 0.75),
    ],
    "array_pieces": [(["a", "b", "x«nm»"], ["1", "2", "«a»"], "a1|b2|x«nm»«a»", "x«nm»", "a|b", "b2"), (["a", "b", "«k»"], ["1"], "a1", "«k»", "a|b", None)],
    "label_masks": [(["1", "2", "CAST(a AS INT)", "4"], 2, 6, "-100,-100,«a»,4,-100,-100", True), (["CAST(a AS INT)", "2"], 2, 2, "-100,-100", True), (["1", "CAST(a AS INT)", "3"], 0, 3, "1,«a»,3", True)],
    "nested_responses": [('{"choices": [{"message": {"content": "«nm»"}}]}', "«nm»", "«nm»"), ('{"choices": []}', None, "none"), ("not json «k»", None, "none")],
    "coalesced": [("«nm»", "y", "z", "«nm»", "«nm»"), ("", "«nm»", "z", "«nm»", ""), (None, "", "«nm»", "«nm»", ""), (None, None, None, "", None)],
    "file_names": [("out/«a»_data.jsonl", "out/«a»_data.manifest.json", "out/«a»-data.jsonl", "«a»_data"), ("a/s«k»_records.jsonl", "a/s«k»_manifest.json", "a/s«k»-records.jsonl", "s«k»_records"), ("My_Pkg>=«a».1", "My_Pkg>=«a».1.manifest.json", "my-pkg", "My_Pkg>=«a»")],
    "stage_ladder": [("math", "=CASE k % 4 WHEN 0 THEN 'Level 1' WHEN 1 THEN 'Level 3' WHEN 2 THEN 'Level 4' ELSE 'Level 5' END", 10, "k % 4 + 1"), ("numina", "other", "CAST(CASE k % 4 WHEN 0 THEN 149 WHEN 1 THEN 150 WHEN 2 THEN 799 ELSE 800 END AS INT)", "k % 4 + 1"), ("openr1", None, "CAST(1000 + e AS INT)", "3 + e")],
    "difficulty_levels": [("CAST(k % 11 AS DOUBLE)", "CASE WHEN k % 11 >= 9 THEN 1 WHEN k % 11 >= 7 THEN 2 WHEN k % 11 = 6 THEN 3 WHEN k % 11 = 5 THEN 5 END")],
    "shortfalls": [("CAST(a AS INT)", 30, 1000, 6500, "CASE WHEN a < 30 THEN 30 - a ELSE 0 END", 30), (0, 6500, "CAST(a * 10 AS INT)", 1500, 6500, "6500 - 10 * a")],
}


def expression(x: object, kind: str, spark: bool) -> str:
    """SQL of a value of a template."""
    if x is None:
        return "NULL"
    if kind.startswith("array<"):
        return f"array({', '.join(expression(y, kind[6:-1], spark) for y in x)})"
    if kind != "string":
        return str(x)
    if x.startswith("="):
        return x[1:]
    literal = lambda t: "'" + (t.replace("\\", "\\\\") if spark else t).replace("'", "\\'" if spark else "''") + "'"
    parts = [literal(p) if i % 2 == 0 else p for i, p in enumerate(re.split("«(.*?)»", x)) if p or i % 2]
    return f"concat({', '.join(parts)})" if parts else "''"


def column(rows: list[tuple], at: int, kind: str, spark: bool) -> str:
    """SQL of one column over all rows of the table: each row by its own template."""
    cases = " ".join(f"WHEN {i} THEN {expression(r[at], kind, spark)}" for i, r in enumerate(rows))
    kind = kind if spark else SQL[kind]
    return f"CAST(CASE k % {len(rows)} {cases} END AS {'BIGINT' if kind == 'long' else kind})"
