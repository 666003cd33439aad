"""Sequences held in tables, a row an element: cells of attempts, frames, paths, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = "array<struct<row:long,col:long,expected:long,is_clue:boolean>>"


def attempt_cells(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(keys, row, col, expected) of the cells in a JSON payload that are no clues and have a place; a payload that can't be read has none."""
    cells = payloads.select(*keys, F.inline(F.from_json(payload, CELLS)))
    return cells.where(~F.coalesce("is_clue", F.lit(False)) & F.col("row").isNotNull() & F.col("col").isNotNull()).select(*keys, "row", "col", "expected")


def join_by_file(files: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    """Files with the entry of the same file name; names are equal as they stand, null ones meet nothing."""
    return files.join(entries.hint("merge"), name)


def aligned(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, expected, actual, same) place by place, where either sequence has one; a place that one lacks differs,
    unless the other holds a null there."""
    left, right = (df.groupBy(*keys).agg(F.max(value).alias(n)) for df, n in ((expected, "expected"), (actual, "actual")))
    return left.join(right.hint("merge"), keys, "full").withColumn("same", F.col("expected").eqNullSafe(F.col("actual")))


def judged_cells(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, is_correct) of every cell of the truth; a cell without a prediction is wrong."""
    own = truth.join(found.hint("merge"), keys, "left")
    return own.select(*keys, F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).alias("is_correct"))


def first_known(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first value by `order` that isn't null, of each key; null if there is none."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def ends(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, first, last) by order, in one aggregate."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def strided(rows: DataFrame, order: str, step: int) -> DataFrame:
    """Every step-th row by its number, from 0; a step below 1 counts as 1."""
    return rows.where(F.col(order) % max(1, step) == 0)


def in_order(rows: DataFrame, keys: list[str], value: str, order: str, name: str, descending: bool = False) -> DataFrame:
    """(keys, name): the values of each key as an array, by order, then by value."""
    pairs = F.sort_array(F.collect_list(F.struct(order, value)), not descending)
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def first_mentions(items: str | Column, most: int) -> Column:
    """The distinct values of an array in the order of their first mention, the first `most` of them."""
    return F.slice(F.array_distinct(items), 1, most)


def edge_gaps(rows: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """(keys, gap, ok): the smallest gap between neighbouring values, and whether it is large enough; one value has no gap and is fine."""
    gap = F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(value))
    return rows.withColumn("_gap", gap).groupBy(*keys).agg(F.min("_gap").alias("gap"), F.coalesce(F.min("_gap") >= least, F.lit(True)).alias("ok"))
