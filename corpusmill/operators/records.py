"""Record shapes: one select for each source, the validators of the builds, tags and buckets.

Columns that a source lacks count as null; a null text is an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rules import Rule, first_reason, reasons_for

# The source of anchors, words that mark a table, and (below) the reasons that validators give.
ANCHOR = "anchor"
TABLE_WORDS = ("table", "complete the table", "select the most appropriate")


def field(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or a null of its type where the table has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _answer(solution: Column) -> Column:
    found = T.boxes_shallow(solution)
    return F.coalesce(F.when(F.size(found) > 0, F.element_at(found, -1)), F.lit(""))


def _said(messages: Column, role: str) -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def pool(df: DataFrame, source: str) -> DataFrame:
    """problem, solution, answer, level and source of one of the known sources."""
    f = lambda name, kind="string": field(df, name, kind)
    empty, unknown = F.lit(""), F.lit("unknown")
    chat = "array<struct<role:string,content:string>>"
    if source == "math":
        solution = F.coalesce(f("solution"), empty)
        parts = f("problem"), solution, _answer(solution), F.coalesce(f("level").cast("string"), unknown)
    elif source == "s1k":
        solution = T.falsy_coalesce(f("deepseek_thinking_trajectory"), f("gemini_thinking_trajectory"))
        parts = f("question"), solution, _answer(T.falsy_coalesce(f("deepseek_attempt"), f("gemini_attempt"))), unknown
    elif source == "numina":
        solution = T.falsy_coalesce(f("solution"), _said(f("messages", chat), "assistant"))
        parts = T.falsy_coalesce(f("problem"), _said(f("messages", chat), "user")), solution, _answer(solution), F.coalesce(f("source"), unknown)
    elif source == "stratos":
        turns = f("conversations", "array<struct<value:string>>")
        at = lambda i: F.when(F.size(turns) >= 2, F.get(turns, F.lit(i))["value"])
        solution = F.coalesce(at(1), empty)
        parts = at(0), solution, _answer(solution), unknown
    elif source == "openr1":
        parts = f("problem"), F.coalesce(F.get(f("generations", "array<string>"), F.lit(0)), empty), f("answer"), F.coalesce(f("source"), unknown)
    else:
        raise ValueError(f"no such source: {source}")
    names = ("problem", "solution", "answer", "level")
    return df.select(*[F.coalesce(c, empty).alias(n) for n, c in zip(names, parts, strict=True)], F.lit(source).alias("source"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def training_record(df: DataFrame, source: str) -> DataFrame:
    """question, options, answer, reasoning, source, n_ans and is_mcq; a stored n_ans of 0 is counted anew."""
    options = field(df, "options", "array<string>")
    blanks = F.greatest(T.count_blanks("question"), F.lit(1))
    n = F.coalesce(F.nullif(field(df, "n_ans", "int"), F.lit(0)), blanks)
    return df.select("question", options.alias("options"), "answer", field(df, "reasoning").alias("reasoning"), F.lit(source).alias("source"), n.cast("int").alias("n_ans"), (F.coalesce(F.size(options), F.lit(0)) > 0).alias("is_mcq"))


def anchors(df: DataFrame) -> DataFrame:
    return df.withColumns({"original_source": F.col("source"), "original_bucket": field(df, "bucket"), "source": F.lit(ANCHOR)})


def tagged(df: DataFrame, tag: str = "public") -> DataFrame:
    return df.withColumn("eval_source", F.coalesce(field(df, "eval_source"), F.lit(tag)))


def rl_problem(df: DataFrame, answers: Column, level: int = 3) -> DataFrame:
    return df.select(F.concat(F.lit("public_"), F.col("id").cast("string")).alias("id"), "question", answers.alias("gold_answer"), F.coalesce(field(df, "options", "array<string>"), F.array().cast("array<string>")).alias("options"), F.lit(level).alias("difficulty_level"), F.lit("public").alias("source"))


def answer_type(options: Column, n_answers: Column) -> Column:
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, "mcq").when(n_answers > 1, "multi").otherwise("single")


def distill_bucket(question: Column, options: Column) -> Column:
    """mcq10, table_many, multi or single; null is dropped."""
    n, k = T.count_blanks(question), F.coalesce(F.size(options), F.lit(0))
    return F.when(k >= 7, "mcq10").when((n >= 5) | F.coalesce(T.contains_any(F.lower(question), TABLE_WORDS), F.lit(False)), "table_many").when(n > 1, "multi").when((n == 1) & (k == 0), "single")


def answer_rules(answer: Column, longest: int = 50) -> list[Rule]:
    a = T.trim(F.coalesce(answer, F.lit("")))
    return [Rule("empty_answer", a == ""), Rule("answer_too_long", F.length(a) >= longest), Rule("answer_has_newline", F.rlike(a, F.lit(r"[\r\n]")))]


def pool_is_valid(df: DataFrame) -> Column:
    """Between 100 and 2000 words (5000 for s1k), an answer, and a problem of more than 10 characters."""
    n = T.word_count("solution")
    return (n > 100) & (n < F.when(F.col("source") == "s1k", 5000).otherwise(2000)) & (F.col("answer") != "") & (F.length("problem") > 10)


def record_reason(min_words: int = 50, longest: int = 80) -> Column:
    """The first reason against a record of question, options, answer, target_answer, target, reasoning, source and is_mcq; anchors have rules of their own."""
    reason, answer = F.coalesce("reasoning", F.lit("")), F.coalesce("answer", F.lit(""))
    target = F.coalesce("target_answer", answer)
    bad = lambda a: (a == "") | (F.length(a) >= longest) | F.rlike(a, F.lit(r"[\r\n]"))
    options = F.coalesce(F.size("options"), F.lit(0)) > 0
    tags = lambda t, tag: F.regexp_count(t, F.lit(tag))
    chinese = Rule("chinese_question", T.has_cjk("question"))
    t = F.coalesce("target", F.lit(""))
    special = [chinese, Rule("anchor_bad_think_tag_count", (tags(t, "<think>") != 1) | (tags(t, "</think>") != 1))]
    ordinary = [
        chinese, Rule("think_tags", F.rlike(reason, F.lit("</?think>"))), Rule("boxed_remains", F.contains(reason, F.lit("\\boxed"))), Rule("noise_phrase_remains", T.has_noise(reason)), Rule("chinese_characters", T.has_cjk(reason)),
        Rule("reasoning_too_short", T.word_count(reason) < min_words), Rule("non_letter_mcq_target_answer", (F.col("is_mcq") | options) & ~F.rlike(target, F.lit("^[A-J]$"))), Rule("mcq_without_options", F.col("is_mcq") & ~options),
        Rule("invalid_answer_field", bad(answer)), Rule("invalid_target_answer_field", bad(target)),
    ]
    return reasons_for(F.col("source") == ANCHOR, special, ordinary)


def target_reason(min_words: int = 50) -> Column:
    """The first reason against a row of question, reasoning and answer whose target is rendered from the last two; null if it is sound."""
    question, reasoning, answer = (F.coalesce(c, F.lit("")) for c in ("question", "reasoning", "answer"))
    target = T.render_target(reasoning, answer)
    tags = (F.regexp_count(target, F.lit("<think>")) != 1) | (F.regexp_count(target, F.lit("</think>")) != 1)
    box = (T.count_boxes(target) != 1) | ~F.endswith(F.rtrim(target), F.concat(F.lit("\\boxed{"), answer, F.lit("}")))
    return first_reason([
        Rule("empty_question", T.trim(question) == ""), Rule("chinese_question", T.has_cjk(question)), Rule("mcq_like", T.looks_like_mcq(question, answer)), Rule("chinese_rendered_target", T.has_cjk(target)), Rule("bad_think_tag_count", tags), Rule("bad_boxed_structure", box),
        Rule("reasoning_too_short", T.word_count(reasoning) < min_words), Rule("boxed_in_reasoning", F.contains(reasoning, F.lit("\\boxed"))),
    ])


def length_bucket(words: Column, limits: tuple[int, int] = (500, 1500)) -> Column:
    return F.when(words < limits[0], "easy").when(words < limits[1], "medium").otherwise("hard")


def graded_trace(df: DataFrame) -> Column:
    """struct(trace, attempt, origin): the first teacher's if graded yes, else the second's if graded yes and the first no."""
    grade = lambda c: F.lower(T.trim(F.coalesce(field(df, c), F.lit(""))))
    pick = lambda who: F.struct(field(df, f"{who}_thinking_trajectory").alias("trace"), field(df, f"{who}_attempt").alias("attempt"), F.lit(who).alias("origin"))
    none = F.struct(F.lit(None).cast("string").alias("trace"), F.lit(None).cast("string").alias("attempt"), F.lit("unverified").alias("origin"))
    first = grade("deepseek_grade")
    return F.when(first == "yes", pick("deepseek")).when((first == "no") & (grade("gemini_grade") == "yes"), pick("gemini")).otherwise(none)


def required(df: DataFrame, names: list[str]) -> Column:
    """The required fields that a row lacks."""
    return F.array_compact(F.array(*[F.when(field(df, n).isNull(), F.lit(n)) for n in names]))


def first_known(df: DataFrame, names: list[str]) -> Column:
    """The first of the named fields that is there and not null; empty strings count."""
    return F.coalesce(*[field(df, n) for n in names])


def zipped(a: str, b: str) -> Column:
    """array of struct(x, y) of two arrays' elements, as far as both reach; null arrays are empty."""
    empty = lambda c: F.coalesce(F.col(c), F.array())
    n = F.least(F.size(empty(a)), F.size(empty(b)))
    return F.transform(F.slice(empty(a), F.lit(1), n), lambda x, i: F.struct(x.alias("x"), F.get(F.col(b), i).alias("y")))


def verified(generations: str, complete: str, correct: str) -> Column:
    """The generations that are complete and verified; one beyond either list is neither."""
    holds = lambda flags, i: F.coalesce(F.get(F.coalesce(F.col(flags), F.array().cast("array<boolean>")), i), F.lit(False))
    return F.filter(F.coalesce(F.col(generations), F.array().cast("array<string>")), lambda g, i: holds(complete, i) & holds(correct, i))


def response_content(doc: str) -> Column:
    """The first choice's message in a stored response; null if there is none."""
    return F.get_json_object(F.col(doc), "$.choices[0].message.content")


# What each kind of question asks a teacher for.
TEACHER_HINTS = {
    "mcq10": "Give the letter of one option in the box.", "multi": "Give all values in the box, in order, with commas between them.", "table_many": "Fill every blank of the table, in order, with commas between them.",
    "single": "Give one value in the box.",
}


def teacher_prompt(bucket: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TEACHER_HINTS.items() for x in kv]), bucket)


# Parts of sub-source names and the stage that they stand for, in the order in which they are tried; word counts from which the next stage begins.
SUB_SOURCES = (("cn_k12", 1), ("synthetic_math", 1), ("orca_math", 1), ("gsm8k", 1), ("synthetic_amc", 2), ("math", 2), ("aops_forum", 3), ("olympiads", 4), ("amc_aime", 4))
STAGE_WORDS = (150, 400, 800)


def stage(source: str, level: str, words: str) -> Column:
    """The curriculum's stage, 1 to 5, by source, level or sub-source (both in ``level``), and length."""
    n, number, sub = F.col(words), T.level_number(F.col(level)), F.lower(F.coalesce(F.col(level), F.lit("")))
    by_level = F.when(number <= 2, 1).when(number == 3, 2).when(number == 4, 3).otherwise(4)
    by_words = F.when(n < STAGE_WORDS[0], 1).when(n < STAGE_WORDS[1], 2).when(n < STAGE_WORDS[2], 3).otherwise(4)
    by_name = F.coalesce(*[F.when(F.contains(sub, F.lit(part)), F.lit(k)) for part, k in SUB_SOURCES], by_words)
    s = F.col(source)
    return F.when(s == "math", by_level).when(s == "s1k", 4).when(s == "numina", by_name).when(s == "stratos", 5).when(s == "openr1", F.when(n > 1000, 4).otherwise(3)).otherwise(2)


def label_mask(ids: str, prompt: str, width: str) -> Column:
    """Labels of a training row: the prompt's ids masked, then the rest, padded with masks to the width."""
    mask = lambda n: F.array_repeat(F.lit(-100), F.greatest(n, F.lit(0)))
    p = F.least(F.col(prompt), F.size(ids))
    return F.concat(mask(p), F.slice(F.col(ids), p + 1, F.size(ids)), mask(F.col(width) - F.size(ids)))


def prompt_is_prefix(prompt: str, full: str) -> Column:
    """True, or the query fails: a prompt must begin the text that it is masked in."""
    return F.when(F.startswith(F.col(full), F.col(prompt)), True).otherwise(F.raise_error(F.lit("the prompt doesn't begin the text")).cast("boolean"))


def audit(df: DataFrame, bands: dict[str, tuple[int, int]], other: tuple[int, int] = (100, 2000)) -> DataFrame:
    """For each source of a pool: rows, and how many have a problem, an answer and a length strictly within the source's band, in percent too."""
    n, low, high = T.word_count("solution"), F.lit(other[0]), F.lit(other[1])
    for name, (a, b) in bands.items():
        low, high = F.when(F.col("source") == name, a).otherwise(low), F.when(F.col("source") == name, b).otherwise(high)
    tests = {"has_problem": F.length("problem") > 10, "has_boxed": F.col("answer") != "", "in_word_range": (n > low) & (n < high)}
    counts = [F.count_if(t).alias(k) for k, t in tests.items()]
    shares = [F.round(100 * F.count_if(t) / F.count("*"), 1).alias(f"{k}_percent") for k, t in tests.items()]
    return df.groupBy("source").agg(F.count("*").alias("n"), *counts, *shares)


def projected(df: DataFrame, kind: str) -> DataFrame:
    """question, options, answer, reasoning, source, n_ans and is_mcq of one of the builds' sources.

    ``verified``: problem, answer, generations with their flags; ``instruct``: instruction
    with inline options, output with a letter; ``difficulty``: question, final_answer and
    three solutions; ``graded``: question and two graded teachers; ``clean``: a record as it
    is, with target_answer and original_source. Reasoning is the shortest clean trace; rows
    without one have a null reasoning.
    """
    none = F.lit(None).cast("array<string>")
    if kind == "verified":
        parts = F.col("problem"), none, T.final_answer("answer")["answer"], T.shortest_clean(verified("generations", "is_reasoning_complete", "correctness_math_verify"))
    elif kind == "instruct":
        options = T.inline_options("instruction")
        ordered = T.labels_continuous(F.transform(options, lambda o: o["label"]))
        parts = F.col("instruction"), F.when(ordered, F.transform(options, lambda o: o["text"])), T.mcq_letter("output"), T.clean_trace(T.drop_letter_sentence("output"), 1)["text"]
    elif kind == "difficulty":
        parts = F.col("question"), none, T.final_answer("final_answer")["answer"], T.shortest_clean(F.array_compact(F.array("r1_solution_1", "r1_solution_2", "r1_solution_3")))
    elif kind == "graded":
        chosen = graded_trace(df)
        parts = F.col("question"), none, T.solution_answer(chosen["attempt"]), T.clean_trace(chosen["trace"])["text"]
    elif kind == "clean":
        return df.select("question", field(df, "options", "array<string>").alias("options"), "answer", "reasoning", "source", F.greatest(T.count_blanks("question"), F.lit(1)).alias("n_ans"), (F.coalesce(F.size(field(df, "options", "array<string>")), F.lit(0)) > 0).alias("is_mcq"), F.coalesce(field(df, "target_answer"), F.col("answer")).alias("target_answer"), F.coalesce(field(df, "original_source"), F.col("source")).alias("original_source"))
    else:
        raise ValueError(f"no such projection: {kind}")
    question, options, answer, reasoning = parts
    return df.select(question.alias("question"), options.alias("options"), answer.alias("answer"), reasoning.alias("reasoning"), F.lit(kind).alias("source"), F.greatest(T.count_blanks(question), F.lit(1)).alias("n_ans"), (F.coalesce(F.size(options), F.lit(0)) > 0).alias("is_mcq"))
