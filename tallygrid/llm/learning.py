"""What the two classifiers share: the bounded sample of labelled rows that they learn from, and the held-out rule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from, at most: the documented bound of its fit. Everything else covers all rows.
SAMPLE = 20_000


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of a doc_id as text, modulo `of`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE, folds: int = 5) -> DataFrame:
    """(doc_id, text, y): texts of the first `rows` learnable labelled rows in a fixed shuffled order.

    Rows that are held out (remainder 0), without a label or without a doc_id are never learnt from. Of a doc_id with
    several labels the largest counts. The sample has `rows` short rows at most, so it is broadcast and no text moves.
    """
    own = labels.where(f"doc_id is not null and {label} is not null").where(remainder("doc_id", folds) != 0)
    own = own.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    own, n = own.withColumn("_h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))), own.count()
    if n > rows:  # nearly all rows go before any are sorted
        own = own.where(F.col("_h") < math.ceil((rows + 8 * math.sqrt(rows)) / n * (1 << 40)))
    chosen = own.orderBy("_h", "doc_id").limit(rows).drop("_h")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
