"""Rewards of completions, their windowed diagnostics and stop rules."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .select import global_rank, running

# The reward table and its limits.
CORRECT = {"ideal_box": 1.00, "scattered_box": 0.70, "usable_bad_format": 0.50, "no_usable_box": 0.30}
WRONG = {"ideal_box": 0.10, "scattered_box": -0.30, "usable_bad_format": 0.00, "no_usable_box": -0.20}
UNUSABLE_CAP, CLIPPED, MULTI_BONUS, MULTI_PENALTY, LETTER_BONUS, LETTER_PENALTY, FLOOR, CEILING = -0.30, 0.25, 0.10, 0.15, 0.03, 0.05, -0.50, 1.00
MAX_NEW_TOKENS, FLAT_LOGS, FLAT_SPAN, MAX_KL, MAX_LENGTH = 6144, 9, 0.005, 10.0, 7000


def analysis(completion: str, n_gold: str, has_options: str) -> dict[str, Column]:
    """Flags of a completion; the box shapes count after the thoughts, before them, and over all."""
    t = F.col(completion)
    usable = lambda x: F.size(F.filter(T.boxes_shallow(x), lambda b: b != "")) > 0
    thought = F.contains(t, F.lit("</think>"))
    raw, full = T.count_boxes(t), F.size(F.filter(T.boxes_shallow(t), lambda b: b != ""))
    ideal = thought & usable(T.after_think(t))
    return {
        "has_usable_box": full > 0, "ideal_box": ideal, "is_scattered": (full > 0) & (raw > full), "unusable_box": (raw > 0) & (full == 0), "missing_think": ~thought & (full > 0), "prethink_box": thought & ~ideal & (full > 0),
        "clipped": T.token_proxy(t) >= MAX_NEW_TOKENS - 10, "answer_text": F.coalesce(F.element_at(F.filter(T.boxes_shallow(t), lambda b: b != ""), F.when(full > 0, F.lit(-1))), F.lit("")), "is_multi": F.col(n_gold) > 1, "is_mcq": F.col(has_options),
    }


def shape() -> Column:
    return F.when(F.col("ideal_box"), "ideal_box").when(F.col("is_scattered"), "scattered_box").when(F.col("has_usable_box"), "usable_bad_format").otherwise("no_usable_box")


def base_reward(correct: Column, kind: Column, unusable: Column, clipped: Column) -> Column:
    table = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), kind)
    r = F.when(correct, table(CORRECT)).otherwise(table(WRONG))
    return F.when(unusable, F.least(r, F.lit(UNUSABLE_CAP))).otherwise(r) - F.when(clipped, CLIPPED).otherwise(0.0)


def shape_adjustment(parts: Column, n_gold: Column, multi_usable: Column, mcq: Column, letter: Column) -> Column:
    several = F.when(multi_usable, F.when(parts == n_gold, MULTI_BONUS).otherwise(-MULTI_PENALTY)).otherwise(0.0)
    return several + F.when(mcq, F.when(letter, LETTER_BONUS).otherwise(-LETTER_PENALTY)).otherwise(0.0)


def clamp(r: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), r))


def reward(df: DataFrame, completion: str, correct: str, n_gold: str, has_options: str) -> DataFrame:
    """The rows with their flags, ``shape`` and ``reward``."""
    out = df.withColumns(analysis(completion, n_gold, has_options)).withColumn("shape", shape())
    letter = F.rlike("answer_text", F.lit("^[A-Ja-j]$"))
    base = base_reward(F.col(correct), F.col("shape"), F.col("unusable_box"), F.col("clipped"))
    more = shape_adjustment(F.size(T.split_flat("answer_text")), F.col(n_gold), F.col("is_multi") & F.col("has_usable_box"), F.col("is_mcq"), letter)
    return out.withColumn("reward", F.round(clamp(base + more), 6))


def reward_of(completion: str, correct: str, n_gold: str, has_options: str) -> Column:
    """The reward alone, as one expression."""
    flags = analysis(completion, n_gold, has_options)
    kind = F.when(flags["ideal_box"], "ideal_box").when(flags["is_scattered"], "scattered_box").when(flags["has_usable_box"], "usable_bad_format").otherwise("no_usable_box")
    more = shape_adjustment(F.size(T.split_flat(flags["answer_text"])), F.col(n_gold), flags["is_multi"] & flags["has_usable_box"], flags["is_mcq"], F.rlike(flags["answer_text"], F.lit("^[A-Ja-j]$")))
    return F.round(clamp(base_reward(F.col(correct), kind, flags["unusable_box"], flags["clipped"]) + more), 6)


def reward_udf(fn: Callable[..., list[float]]):
    """A function of lists (prompts, completions, further columns) that gives a list of rewards, as a column function over Arrow batches."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(fn(*[c.tolist() for c in columns]), dtype="float64")

    return F.pandas_udf(run, "double")


def windows(df: DataFrame, step: str, reward: str, tag: str, every: int = 25) -> DataFrame:
    """Mean reward and tag shares of each window of steps."""
    per = df.groupBy(F.floor(F.col(step) / every).alias("window"), tag).agg(F.count("*").alias("n"), F.sum(reward).alias("r"))
    w = Window.partitionBy("window")
    return per.select("window", tag, "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.round(F.sum("r").over(w) / F.sum("n").over(w), 6).alias("mean_reward"))


def flat(df: DataFrame, step: str, mean: str, logs: int = FLAT_LOGS, span: float = FLAT_SPAN, by: list[str] | None = None) -> DataFrame:
    """Whether the last ``logs`` means, this one included, lie within ``span``.

    Without groups the logs are dealt out by ranges of their rank, each with a halo of
    the ``logs - 1`` rows before it.
    """
    width = lambda w: F.max(mean).over(w) - F.min(mean).over(w)
    if by:
        w = Window.partitionBy(*by).orderBy(step).rowsBetween(1 - logs, 0)
        return df.withColumn("flat", (F.count(mean).over(w) >= logs) & (width(w) < span))
    ranked, size = global_rank(df, [step], "_rank"), max(64, 4 * logs)
    home = F.floor(F.col("_rank") / size)
    halo = F.when(F.col("_rank") % size >= size - (logs - 1), F.array(home, home + 1)).otherwise(F.array(home))
    spread = ranked.withColumn("_range", F.explode(halo))
    w = Window.partitionBy("_range").orderBy("_rank").rowsBetween(1 - logs, 0)
    return spread.withColumn("flat", (F.count(mean).over(w) >= logs) & (width(w) < span)).filter(F.col("_range") == home).drop("_rank", "_range")


# The flags whose shares are logged for each window, and the kinds of questions.
TAGS = ("correct", "wrong", "ideal_box", "usable_bad_format", "fallback_missing_think", "prethink_box", "no_usable_box", "empty_or_unusable_box", "scattered_box", "clipped", "multi_count_match", "multi_count_mismatch", "mcq_letter", "mcq_bad_shape")
KINDS = ("mcq", "multi", "single")


def tag_rates(df: DataFrame, step: str, reward: str, tags: str, kind: str, every: int = 25) -> DataFrame:
    """One row for each window of steps: completions, mean reward, the share of each tag, and by kind of question the count and the shares of correct, ideal and clipped ones; nothing is divided by 0."""
    n, has = F.count("*"), lambda t: F.array_contains(F.col(tags), t)
    rate = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    out = [n.alias("completions"), F.round(F.sum(reward) / n, 6).alias("mean")]
    out += [rate(F.count_if(has(t)), n).alias(f"{t}_rate") for t in TAGS]
    for k in KINDS:
        of = F.col(kind) == k
        out += [F.count_if(of).alias(f"{k}_count")] + [rate(F.count_if(of & has(t)), F.count_if(of)).alias(f"{k}_{t}_rate") for t in ("correct", "ideal_box", "clipped")]
    mcq = F.col(kind) == "mcq"
    out += [rate(F.count_if(mcq & has(t)), F.count_if(mcq)).alias(f"{t}_among_mcq_rate") for t in ("mcq_letter", "mcq_bad_shape")]
    return df.groupBy(F.floor(F.col(step) / every).alias("window")).agg(*out)


def cumulative(df: DataFrame, order: str, reward: str, every: int = 200) -> DataFrame:
    """The running count and mean reward at each ``every``-th row."""
    rows = running(df.select(order, reward), [], [order], {"_n": F.lit(1).cast("long"), "_sum": F.col(reward)})
    done = rows.select((F.col("_n") + 1).alias("n"), ((F.col("_sum") + F.col(reward)) / (F.col("_n") + 1)).alias("mean"))
    return done.filter(F.col("n") % every == 0)


def stop_reason(is_flat: Column, kl: Column, length: Column) -> Column:
    """The last rule that holds, by this order: flat, kl, length."""
    return F.coalesce(F.when(length > MAX_LENGTH, F.lit("length")), F.when(kl > MAX_KL, F.lit("kl")), F.when(is_flat, F.lit("flat")))
