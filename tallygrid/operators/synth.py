"""Seeded options and orders: functions of seed and id alone, alike at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(items: Column, *seed: Column) -> Column:
    """items in the order of a seeded hash, which any engine has."""
    text = lambda x: F.concat_ws(":", *(s.cast("string") for s in seed), x.cast("string"))
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.md5(text(x)).alias("h"), x.alias("x")))), lambda s: s["x"])


def options(answer: Column, pool: Column, k: int, seed: str | int, key: Column) -> Column:
    """The answer and k - 1 distinct others of the pool, in a seeded order."""
    others = F.slice(_order(F.array_distinct(F.filter(pool, lambda x: ~x.eqNullSafe(answer))), F.lit(seed), key), 1, k - 1)
    return _order(F.array_append(others, answer), F.lit(f"{seed}:order"), key)


def numeric_options(answer: Column, k: int, seed: str | int, key: Column) -> Column:
    """Distractors from 0 up to the least of 10, 100, ... 100000 that isn't below the answer; null beyond."""
    own = answer.cast("int")
    top = F.array_min(F.filter(F.array(*(F.lit(10**n) for n in range(1, 6))), lambda t: t >= own))
    return F.when(top.isNotNull() & (own >= 0), options(own, F.sequence(F.lit(0), F.coalesce(top, F.lit(10)) - 1), k, seed, key))


def epoch_key(key: str, seed: int, epoch: int) -> Column:
    """60 bits of a hash of seed, epoch and key."""
    return F.expr(f"cast(conv(substr(md5(concat_ws(':', '{seed}', '{epoch}', cast({key} as string))), 1, 15), 16, 10) as bigint)")


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, skip: int = 0, slice_rows: int = 1_000_000) -> DataFrame:
    """S3: rows with their `position` in the order of seed and epoch, from 0, after the first `skip`; key is unique.

    The order is that of a hash. Hashes are cut into slices of about slice_rows rows, whose sizes are summed to offsets; a
    row is numbered inside its slice, and slices that end before `skip` aren't sorted at all. So an epoch goes on where it
    stopped with any number of tasks.
    """
    slices = max(1, -(-rows.count() // slice_rows))
    own = rows.withColumn("_h", epoch_key(key, seed, epoch)).withColumn("_slice", F.expr(f"_h div {-(-(1 << 60) // slices)}"))
    sizes = own.groupBy("_slice").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_slice", "_n", (F.sum("_n").over(W.orderBy("_slice")) - F.col("_n")).alias("_before")).where(F.col("_before") + F.col("_n") > skip)  # one row a slice
    place = F.row_number().over(W.partitionBy("_slice").orderBy("_h", key))
    own = own.join(sizes.hint("merge"), "_slice").withColumn("position", (F.col("_before") + place - 1).cast("long"))
    return own.where(F.col("position") >= skip).select(*rows.columns, "position")
