"""Summaries of scored rows; they hold for streams too, as none needs an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_columns() -> list[Column]:
    """A1: totals of the tri-state pass column and of non-empty errors."""
    return [
        F.count("*").alias("total"),
        F.count_if("offline_pass").alias("passed"),
        F.count_if(~F.col("offline_pass")).alias("failed"),
        F.count_if(F.length("error") > 0).alias("errors"),
    ]


def run_summary(records: DataFrame) -> DataFrame:
    return records.agg(*run_columns())


def grouped_summary(records: DataFrame) -> DataFrame:
    """A2: the same by group, by type and over all, in one pass."""
    own = records.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in ("task_group", "task_type")})
    level = (F.grouping("task_group") * 2 + F.grouping("task_type")).cast("int").alias("level")
    return own.groupingSets([["task_group"], ["task_type"], []], "task_group", "task_type").agg(level, *run_columns())


def accuracy(correct: Column) -> list[Column]:
    """A3: total, correct and their share, 0 without rows; only True is correct."""
    return [F.count("*").alias("total"), F.count_if(correct).alias("correct"), F.coalesce(F.try_divide(F.count_if(correct).cast("double"), F.count("*")), F.lit(0.0)).alias("accuracy")]


def judged_metrics(judged: DataFrame) -> DataFrame:
    """A4: (metric, correct, total, accuracy) of last frame, audio, both and any, over completed rows; no rows, no metrics.

    Only 'yes' is correct: an error, or no judgment at all, counts as wrong."""
    own = judged.where("status = 'completed'").select(*(F.coalesce(F.col(f"{k}_judgment") == "yes", F.lit(False)).alias(k) for k in ("last_frame", "audio")))
    own = own.withColumns({"both": F.col("last_frame") & F.col("audio"), "any": F.col("last_frame") | F.col("audio")})
    long = own.unpivot([], ["last_frame", "audio", "both", "any"], "metric", "right")
    return long.groupBy("metric").agg(F.count_if("right").alias("correct"), F.count("*").alias("total"), F.try_divide(F.count_if("right").cast("double"), F.count("*")).alias("accuracy"))


def generation_report(records: DataFrame, canonical: DataFrame, deduplicated: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """By task type: records, canonical rows, rows after dedup, dropped; raises where `expected` (task_type, n) differs."""
    count = lambda df, name: df.groupBy("task_type").agg(F.count("*").alias(name))
    out = count(records, "n_records").join(count(canonical, "n_canonical").hint("merge"), "task_type", "left").join(count(deduplicated, "n_kept").hint("merge"), "task_type", "left").fillna(0)
    out = out.withColumn("n_dropped", F.col("n_canonical") - F.col("n_kept"))
    if expected is not None:
        fail = F.raise_error(F.concat(F.lit("record count of "), F.col("task_type")))
        out = out.join(expected.withColumnRenamed("n", "_n").hint("merge"), "task_type", "left")
        out = out.withColumn("n_records", F.when(F.col("_n").isNull() | (F.col("_n") == F.col("n_records")), F.col("n_records")).otherwise(fail.cast("long"))).drop("_n")
    return out


def distance_report(frames: DataFrame) -> DataFrame:
    """By task: processed, total and average distance, and the totals so far in task order."""
    from pyspark.sql import Window as W

    own = frames.groupBy("task").agg(F.count("*").alias("processed"), F.sum("distance").alias("total"), F.avg("distance").alias("average"))
    so_far = W.orderBy("task")  # one row a task
    return own.withColumns({"processed_so_far": F.sum("processed").over(so_far), "total_so_far": F.sum("total").over(so_far)})
