"""Queries over texts that are made from the rows of ``part``: each form of input has a template, and SQL works out what must come of it.

``tests/cases.py`` holds further inputs and outcomes, stated by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import braces, grading
from ..functions import text as T
from ..operators import records, reward, rules, select
from ..shared import dealt
from .templates import NUMBERS, TEMPLATES, column

class Cases(NamedTuple):
    """given and wanted: columns as DDL; work: the wanted columns from the given ones."""

    given: str
    wanted: str
    work: Callable[[DataFrame], dict[str, Column]]


def names(ddl: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in ddl.split(", ")]


def query(name: str, cases: Cases) -> Callable:
    rows = TEMPLATES[name]

    def run(spark, d):
        numbers = dealt(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_name", "p_brand"), "p_partkey").selectExpr(*[f"{x} AS {k}" for k, x in NUMBERS.items()])
        df = numbers.selectExpr("k AS case_id", *[f"{column(rows, i, kind, True)} AS {k}" for i, (k, kind) in enumerate(names(cases.given))])
        return df.select("case_id", *[c.alias(k) for k, c in cases.work(df).items()])

    return run


def oracle(name: str, cases: Cases) -> str:
    rows, n = TEMPLATES[name], len(names(cases.given))
    wanted = ", ".join(f"{column(rows, n + i, kind, False)} AS {k}" for i, (k, kind) in enumerate(names(cases.wanted)))
    return f"SELECT k AS case_id, {wanted} FROM (SELECT {', '.join(f'{x} AS {k}' for k, x in NUMBERS.items())} FROM part)"


_PAIR = "pred string, gold string"
_VERDICT = "verdict boolean"


def _same(df: DataFrame) -> dict[str, Column]:
    return {"verdict": grading.same_udf("pred", "gold")}


def _kind(kind: str) -> Callable:
    return lambda df: {"verdict": grading.of_kind_udf(kind)("pred", "gold"), "any_kind": grading.same_udf("pred", "gold")}


_ROW = "response string, gold array<string>, options array<string>"
_THREE = ["red", "$blue$.", r"\text{green}"]

TABLES: dict[str, Cases] = {
    # ---- grading: one table for each kind of comparison
    "grade_numeric": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("NV")),
    "grade_expressions": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("EX")),
    "grade_equations": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("EQ")),
    "grade_intervals": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("INT")),
    "grade_lists": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("UOL")),
    "grade_ordered_lists": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("OL")),
    "grade_choices": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("MCS")),
    "grade_letters": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("MCM")),
    "grade_truth": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("TF")),
    "grade_text": Cases(_PAIR, "verdict boolean, any_kind boolean", _kind("OE")),
    "grade_plus_minus": Cases(_PAIR, _VERDICT, _same),
    "grade_normalised": Cases("answer string", "normal string", lambda df: {"normal": grading.text_udf(grading.normalize)("answer")}),
    "extracted_answers": Cases("response string", "found string, strict string", lambda df: {"found": grading.text_udf(grading.extract)("response"), "strict": grading.text_udf(lambda t: grading.extract(t, strict=True))("response")}),
    "judged_responses": Cases(_ROW, "correct boolean, mode string", lambda df: {k: grading.score_udf("response", "gold", "options")[k] for k in ("correct", "mode")}),
    "judged_by_kind": Cases("response string, gold array<string>, kinds array<string>", _VERDICT, lambda df: {"verdict": grading.typed_udf()("response", "gold", "kinds")}),
    "lenient_numbers": Cases(_PAIR, "close boolean, literal boolean", lambda df: {"close": grading.lenient_number(F.col("pred"), F.col("gold")), "literal": grading.literal_equal(F.col("pred"), F.col("gold"))}),
    "lenient_parts": Cases("pred string, gold array<string>", _VERDICT, lambda df: {"verdict": _parts()("pred", "gold")}),
    # ---- boxes, options and candidates
    "boxed_extract": Cases("t string", "n long, boxes string, shallow string", lambda df: {"n": F.size(braces.boxes("t")).cast("long"), "boxes": F.array_join(braces.boxes("t"), "|"), "shallow": F.coalesce(F.array_join(T.boxes_shallow("t"), "|"), F.lit(""))}),
    "split_commas": Cases("t string", "n long, parts string, flat string", lambda df: {"n": F.size(braces.split_commas("t")).cast("long"), "parts": F.array_join(braces.split_commas("t"), "|"), "flat": F.array_join(T.split_flat("t"), "|")}),
    "box_repair": Cases("t string", "unboxed string, without_last string, last string", lambda df: {"unboxed": braces.unbox("t"), "without_last": braces.drop_last_box("t"), "last": F.array_join(braces.last_boxes("t"), "|")}),
    "last_box_command": Cases("t string", "command string, content string", lambda df: {"command": braces.last_command("t"), "content": braces.last_content("t")}),
    "option_parsing": Cases("t string, answer string", "labels string, first string, continuous boolean, mcq boolean", lambda df: {"labels": F.array_join(F.transform(T.inline_options("t"), lambda x: x["label"]), ""), "first": F.get(T.inline_options("t"), F.lit(0))["text"], "continuous": T.labels_continuous(F.transform(T.inline_options("t"), lambda x: x["label"])), "mcq": T.looks_like_mcq("t", F.col("answer"))}),
    "labelled_options": Cases("t string", "options string, embedded boolean, by_label string", lambda df: {"options": F.array_join(T.split_labelled("t"), "|"), "embedded": T.embedded_mcq("t"), "by_label": F.array_join(F.transform(F.array_sort(F.map_entries(T.option_map("t"))), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")}),
    "mcq_letters": Cases("t string, answer string", "letter string, choice string, block string", lambda df: {"letter": T.mcq_letter("t"), "choice": T.canonical_choice("answer", _options()), "block": T.options_block(_options())}),
    "candidates": Cases("t string", "found string", lambda df: {"found": grading.text_udf(lambda t: "|".join("=".join(x) for x in grading.candidates(t)))("t")}),
    "native_candidates": Cases("t string", "n long, found string", lambda df: {"n": F.size(T.answer_candidates("t")).cast("long"), "found": F.array_join(F.transform(T.answer_candidates("t"), lambda x: F.concat_ws("=", x["mode"], x["candidate"])), "|")}),
    "repaired_answers": Cases("t string, n int, mcq boolean", "answer string, ok boolean", lambda df: {"answer": T.repaired_answer("t", "n", F.when(F.col("mcq"), F.array(F.lit("p"), F.lit("q")))), "ok": T.format_ok("t", F.col("n"), F.when(F.col("mcq"), F.array(F.lit("p"), F.lit("q"))))}),
    "final_answers": Cases("t string", "answer string, reason string", lambda df: {"answer": T.final_answer("t")["answer"], "reason": T.final_answer("t")["reason"]}),
    "render_targets": Cases("reason string, answer string", "target string, fault string", lambda df: {"target": T.render_target("reason", "answer"), "fault": T.target_fault(T.render_target("reason", "answer"))}),
    "think_parts": Cases("t string", "block string, after string, reasoning string, bare string", lambda df: {"block": T.think_block("t"), "after": T.after_think("t"), "reasoning": T.reasoning("t"), "bare": T.strip_outer_think("t")}),
    # ---- cleaning
    "abrupt_tails": Cases("t string", "abrupt boolean, code boolean, noise boolean", lambda df: {"abrupt": T.ends_abruptly("t"), "code": T.is_code("t"), "noise": T.has_noise("t")}),
    "cut_at_noise": Cases("t string", "cut string, earliest string", lambda df: {"cut": T.cut_at_noise("t"), "earliest": T.earliest(F.lower("t"), T.NOISE)["phrase"]}),
    "clean_traces": Cases("t string", "words long, reason string, phrase string", lambda df: {"words": T.word_count(T.clean_trace("t")["text"]).cast("long"), "reason": T.clean_trace("t")["reason"], "phrase": T.clean_trace("t")["phrase"]}),
    "answer_tails": Cases("t string", "without string", lambda df: {"without": T.drop_answer_tail("t")}),
    "stage0_texts": Cases("t string", "clean string", lambda df: {"clean": T.stage0_clean("t")}),
    "letter_sentences": Cases("t string", "without string", lambda df: {"without": T.drop_letter_sentence("t")}),
    "shortest_traces": Cases("traces array<string>", "words long", lambda df: {"words": T.word_count(T.shortest_clean("traces")).cast("long")}),
    "small_texts": Cases("t string", "collapsed string, unwrapped string, option string, noise string, level long, letter string", lambda df: {"collapsed": T.collapse_space("t"), "unwrapped": T.unwrap("t"), "option": T.option_key("t"), "noise": T.noise_key("t"), "level": T.level_number("t").cast("long"), "letter": T.bare_letter("t")}),
    # ---- records
    "distill_buckets": Cases("question string, n_options int", "bucket string, kind string, teacher string", lambda df: {"bucket": records.distill_bucket(F.col("question"), _some("n_options")), "kind": records.answer_type(_some("n_options"), T.count_blanks("question")), "teacher": records.teacher_prompt(records.distill_bucket(F.col("question"), _some("n_options")))}),
    "answer_rules": Cases("answer string", "reasons string, letter_fault string", lambda df: {"reasons": F.array_join(rules.all_reasons(records.answer_rules(F.col("answer"))), ","), "letter_fault": F.when(~F.coalesce(F.rlike(F.col("answer"), F.lit("^[A-J]$")), F.lit(False)), F.lit("not_a_letter"))}),
    "target_reasons": Cases("question string, reasoning string, answer string", "reason string", lambda df: {"reason": records.target_reason()}),
    "length_classes": Cases("words int", "bucket string", lambda df: {"bucket": records.length_bucket(F.col("words"))}),
    "reward_contract": Cases("prompt string, completion string, gold string", "reward double", lambda df: {"reward": reward.reward_udf(_exact)("prompt", "completion", "gold")}),
    "verified_generations": Cases("generations array<string>, complete array<boolean>, verified array<boolean>", "n long, best string", lambda df: {"n": F.size(records.verified("generations", "complete", "verified")).cast("long"), "best": T.shortest_clean(records.verified("generations", "complete", "verified"))}),
    "numeric_thresholds": Cases("v string", "reason string", lambda df: {"reason": rules.first_reason(rules.threshold(F.col("v"), 5.0))}),
    "source_rules": Cases("source string", "reason string, competition boolean", lambda df: {"reason": rules.first_reason(rules.source_rules("source", ["openr1", "blocked_set"], ["blocked_set"])), "competition": F.coalesce(rules.like_any("source", ["olympiad", "aops", "aime", "amc"]), F.lit(False))}),
    # ---- rewards
    "reward_table": Cases("completion string, correct boolean, n_gold int, options boolean", "shape string, reward double", lambda df: _rewards(df)),
    # ---- arrays and JSON
    "array_pieces": Cases("xs array<string>, ys array<string>", "pairs string, last string, firsts string, first_b string", lambda df: _pieces()),
    "label_masks": Cases("ids array<int>, prompt int, width int", "labels string, ok boolean", lambda df: {"labels": F.array_join(F.transform(records.label_mask("ids", "prompt", "width"), lambda x: x.cast("string")), ","), "ok": F.col("prompt") <= F.size("ids")}),
    "nested_responses": Cases("doc string", "content string, first string", lambda df: {"content": records.response_content("doc"), "first": F.coalesce(records.response_content("doc"), F.lit("none"))}),
    "coalesced": Cases("a string, b string, c string", "falsy string, first_known string", lambda df: {"falsy": T.falsy_coalesce("a", "b", "c"), "first_known": records.first_known(df, ["a", "missing", "b", "c"])}),
    "file_names": Cases("path string", "manifest string, package string, stem string", lambda df: {"manifest": T.manifest_path("path"), "package": T.package_name("path"), "stem": T.stem("path")}),
    "stage_ladder": Cases("source string, level string, words int", "stage long", lambda df: {"stage": records.stage("source", "level", "words").cast("long")}),
    "difficulty_levels": Cases("d double", "level long", lambda df: {"level": _level().cast("long")}),
    "shortfalls": Cases("accepted int, cap int, anchors int, other int", "short long, target long", lambda df: {"short": select.shortfall(F.col("accepted"), F.col("cap")).cast("long"), "target": select.mix_target(F.col("cap"), F.col("anchors"), F.col("other")).cast("long")}),
}


def _parts():
    @F.pandas_udf("boolean")
    def run(pred: pd.Series, gold: pd.Series) -> pd.Series:
        return pd.Series([grading.close_parts(p, list(g)) for p, g in zip(pred, gold, strict=True)], dtype="boolean")

    return run


def _exact(prompts: list, completions: list, gold: list) -> list[float]:
    """A reward function of the contract: lists in, a list of numbers out."""
    return [1.0 if c == g else 0.0 for c, g in zip(completions, gold, strict=True)]


def _options() -> Column:
    return F.array(*map(F.lit, _THREE))


def _some(n: str) -> Column:
    """As many options as a number says."""
    return F.array_repeat(F.lit("o"), F.col(n))


def _level() -> Column:
    from ..operators import stats

    return stats.difficulty_level(F.col("d"))


def _pieces() -> dict[str, Column]:
    pairs = F.transform(records.zipped("xs", "ys"), lambda p: F.concat(p["x"], p["y"]))
    return {"pairs": F.array_join(pairs, "|"), "last": F.get("xs", F.size("xs") - 1), "firsts": F.array_join(F.slice("xs", 1, 2), "|"), "first_b": F.get(F.reverse(F.filter(pairs, lambda p: F.startswith(p, F.lit("b")))), F.lit(0))}


def _rewards(df: DataFrame) -> dict[str, Column]:
    flags = reward.analysis("completion", "n_gold", "options")
    kind = F.when(flags["ideal_box"], "ideal_box").when(flags["is_scattered"], "scattered_box").when(flags["has_usable_box"], "usable_bad_format").otherwise("no_usable_box")
    return {"shape": kind, "reward": reward.reward_of("completion", "correct", "n_gold", "options")}


QUERIES = {name: query(name, cases) for name, cases in TABLES.items()}
ORACLES = {name: oracle(name, cases) for name, cases in TABLES.items()}
