"""Conversations in the order of their turns, without one task for a conversation that holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.llm.common import cut


def ordered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, written, with a long `at` that rises in the given order.

    Rows are cut into ranges of the order and sorted within them. Equal rows, which no range could part, are also told
    apart by the task that read them.
    """
    keys = [*order, F.col("_reader")]
    ranged = rows.withColumn("_reader", F.spark_partition_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(ranged.withColumn("at", F.monotonically_increasing_id()).drop("_reader"))


def positions(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What `ordered` wrote, with the position (from 0) of each row among those of its key; and (key, n) of every key.

    A key's rows stand in one run or, if ranges have cut it, in one a range: runs are counted and their starts summed.
    Rows with a null key are left out.
    """
    rows = rows.where(F.col(key).isNotNull()).withColumn("_range", F.shiftright("at", 33))
    runs = rows.groupBy(key, "_range").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_range")) - F.col("_n")
    found = rows.join(runs.withColumn("_before", before).hint("merge"), [key, "_range"])
    found = found.withColumn("position", F.col("_before") + F.col("at") - F.col("_first")).drop("_range", "_first", "_n", "_before", "at")
    return found, runs.groupBy(key).agg(F.sum("_n").alias("n"))
