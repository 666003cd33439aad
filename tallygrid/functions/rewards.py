"""Rewards of completions against solutions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.text import Text, blank, col, free_text, missing, reward_path, strip, tagged_answer


def option_reward(completion: Text, solution: Text) -> Column:
    """-1 unless the answer is one letter; 1 if it is the solution's, else 0."""
    pred, target = free_text(completion), free_text(solution)
    return F.when(~pred.rlike(r"^\p{L}$"), -1.0).when(F.upper(pred) == F.upper(target), 1.0).otherwise(0.0)


def same_start(a: Column, b: Column) -> Column:
    """Length of the longest common start of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, n)


def path_reward(completion: Text, solution: Text) -> Column:
    """R2: 1 for the same path, else matched ends over the longer length; -1 if either can't be read; 0 for an empty truth."""
    truth = F.from_json(col(solution), "array<bigint>")
    truth = F.when(strip(col(solution)).rlike(r"^\[.*\]$"), truth)

    def score(pred: Column, truth: Column) -> Column:
        ends = same_start(pred, truth) + same_start(F.reverse(pred), F.reverse(truth))
        part = F.try_divide(F.least(F.size(truth).cast("double"), ends.cast("double")), F.greatest(F.size(truth), F.size(pred)))
        return F.when(truth.isNull(), -1.0).when(F.size(truth) == 0, 0.0).when(pred.isNull(), -1.0).when(pred == truth, 1.0).otherwise(part)

    # a lambda's argument is worked out once, however often it is named
    both = F.array(F.struct(reward_path(completion).alias("pred"), truth.alias("truth")))
    return F.get(F.transform(both, lambda x: score(x["pred"], x["truth"])), 0)


def text_reward(completion: Text, solution: Text) -> Column:
    """-1 for a blank answer, else 1 or 0 by equality of normal forms."""
    pred = free_text(completion)
    return F.when(pred == "", -1.0).otherwise((pred == free_text(solution)).cast("double"))


def format_reward(completion: Text) -> Column:
    """0.1 for anything but white space."""
    return F.when(strip(blank(completion)) != "", 0.1).otherwise(0.0)


def reward(completion: Text, solution: Text) -> Column:
    """By the shape of the solution: [...] a path, longer than one character a text, else an option; null if blank."""
    s = strip(blank(solution))
    return F.when(s == "", None).when(s.startswith("[") & s.endswith("]"), path_reward(completion, s)).when(F.length(s) > 1, text_reward(completion, s)).otherwise(option_reward(completion, s))


def passes(score: Text) -> Column:
    return col(score) >= 0.999


def exact_match(completion: Text, answer: Text) -> Column:
    """Equality of the tagged answer, in lower case; False where none is tagged."""
    return F.coalesce(F.lower(strip(tagged_answer(completion))) == F.lower(strip(col(answer))), F.lit(False))


def maze_pass(overlaps: Text, start: Text, goal: Text, connected: Text) -> Column:
    return ~col(overlaps) & col(start) & col(goal) & col(connected)


def maze_message(overlaps: Text, start: Text, goal: Text, connected: Text) -> Column:
    """The verdict in words, by precedence (fixed values)."""
    return (
        F.when(col(overlaps), "Red path overlaps walls.")
        .when(~col(start), "Red path does not reach the start.")
        .when(~col(goal), "Red path does not reach the goal.")
        .when(~col(connected), "Red path is not continuous between start and goal.")
        .otherwise("Red path successfully connects start to goal.")
    )


def option_pass(is_correct: Text, predicted: Text, voted: Text, correct: Text) -> Column:
    """An explicit verdict wins; else the predicted option, or the vote without one, against the correct option."""
    found = F.coalesce(missing(predicted), col(voted))
    return F.coalesce(col(is_correct), F.coalesce(found == col(correct), F.lit(False)))
