"""Votes over attempts, channels and frames. Every tie rule is an explicit key of an aggregate; no window holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.text import option

#: Channels in the order in which they win ties.
CHANNELS = ("image_option", "video_option", "text_option", "transcribe_option")


def channel_votes(attempts: DataFrame, keys: list[str], channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """A5: most frequent option over the channels; ties go to the first channel that voted for one of them.

    A row has at most one vote a channel, so votes are counted in the row: no shuffle.
    """
    votes = F.array(*(option(c) for c in channels))
    counted = F.transform("_votes", lambda v, i: F.struct(F.size(F.filter("_votes", lambda u: u == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    best = F.array_max(F.filter(counted, lambda s: s["v"].isNotNull()))
    return attempts.withColumn("_votes", votes).select(*keys, best["v"].alias("voted"))


def majority(rows: DataFrame, keys: list[str], value: str, first: str | None = None) -> DataFrame:
    """Most frequent value by key. A6 (first is None): a tie gives null. A7: a tie goes to the value whose `first` is least.

    Null values don't vote; a key without votes is left with null.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), (F.min(first) if first else F.lit(0)).alias("_first"))
    live = F.col(value).isNotNull()
    if first:
        return counts.groupBy(*keys).agg(F.max_by(F.when(live, F.col(value)), F.when(live, F.struct(F.col("_n"), -F.col("_first")))).alias("voted"))
    top = counts.groupBy(*keys).agg(F.max(F.when(live, F.struct("_n", F.col(value).alias("v")))).alias("hi"), F.min(F.when(live, F.struct(-F.col("_n"), F.col(value).alias("v")))).alias("lo"))
    return top.select(*keys, F.when(F.col("hi.v") == F.col("lo.v"), F.col("hi.v")).alias("voted"))


def frame_vote(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label, the least one on a tie, null if there is none."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    live = F.col(label).isNotNull()
    return counts.groupBy(*keys).agg(F.min_by(F.when(live, F.col(label)), F.when(live, F.struct(-F.col("_n"), F.col(label)))).alias("voted"))


def scored_cells(cells: DataFrame, vote: str = "strict") -> DataFrame:
    """(puzzle_id, pos, expected, voted, vote_right, n_attempts, n_right) of every position that is no clue.

    expected is that of the first attempt that has one (W5); attempts without a prediction count as wrong.
    """
    own = cells.where("is_clue = 0")
    truth = own.groupBy("puzzle_id", "pos").agg(F.min_by("expected", F.when(F.col("expected").isNotNull(), F.col("attempt"))).alias("expected"), F.count("*").alias("n_attempts"))
    voted = majority(own, ["puzzle_id", "pos"], "predicted", None if vote == "strict" else "attempt")
    right = own.join(truth.select("puzzle_id", "pos", F.col("expected").alias("_truth")), ["puzzle_id", "pos"]).groupBy("puzzle_id", "pos").agg(F.count_if(F.col("predicted") == F.col("_truth")).alias("n_right"))
    out = truth.join(voted, ["puzzle_id", "pos"]).join(right, ["puzzle_id", "pos"])
    return out.withColumn("vote_right", F.coalesce(F.col("voted") == F.col("expected"), F.lit(False)))


def _rate(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(0.0))


def vote_report(scored: DataFrame) -> DataFrame:
    """By puzzle, and over all (puzzle_id null): positions, vote rate and attempt rate, over sums of positions."""
    one = scored.withColumns({"_v": F.col("vote_right").cast("long"), "_p": F.lit(1)})
    return one.groupingSets([["puzzle_id"], []], "puzzle_id").agg(F.count("*").alias("n_positions"), _rate("_v", "_p").alias("vote_rate"), _rate("n_right", "n_attempts").alias("attempt_rate"), F.grouping("puzzle_id").cast("int").alias("overall"))


def vote_report_by_size(scored: DataFrame) -> DataFrame:
    """A10: the same rates by number of scored positions, with the number of puzzles."""
    puzzles = scored.groupBy("puzzle_id").agg(F.count("*").alias("n_positions"), F.count_if("vote_right").alias("v"), F.sum("n_right").alias("r"), F.sum("n_attempts").alias("a"))
    return puzzles.groupBy("n_positions").agg(F.count("*").alias("n_puzzles"), _rate("v", "n_positions").alias("vote_rate"), _rate("r", "a").alias("attempt_rate"))


def whole_sequences(cells: DataFrame) -> DataFrame:
    """(puzzle_id, attempt, right): an attempt is right only if every expected position is met."""
    return cells.groupBy("puzzle_id", "attempt").agg(F.bool_and(F.coalesce(F.col("predicted") == F.col("expected"), F.col("expected").isNull() & F.col("predicted").isNull())).alias("right"))


def base_colour(record: str) -> Column:
    """Colour of the first coloured cell of a record that has three values; null without one."""
    cells = F.from_json(F.get_json_object(record, "$.colored_cells"), "array<map<string,string>>")
    colours = F.transform(cells, lambda c: F.from_json(F.try_element_at(c, F.lit("color")), "array<double>"))
    return F.get(F.filter(colours, lambda c: F.size(c) == 3), 0)
