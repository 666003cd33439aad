"""A corpus, cleaned and dealt out: toxicity, near duplicates, benchmark leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of docs. Labels and benchmark come from sf_dir. Rows with null or empty texts pass every filter but near dedup,
which keeps the first of repeated rows; they cost nothing in the mixture and are dealt out like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from tallygrid.llm.common import cut, read

#: The mixture may take a document once, so that no copies come back, and takes this share of the tokens.
MIX_SHARE, MIX_EPOCHS = 0.8, 1


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, share=MIX_SHARE, epochs=MIX_EPOCHS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("shard", deal_shards),
]

#: The first stage learns a model, which SQL can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
