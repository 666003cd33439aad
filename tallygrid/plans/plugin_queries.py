"""Queries of the extension points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators import plugins
from tallygrid.plans import text_queries
from tallygrid.plans.fixtures import duck, fixture, table
from tallygrid.plans.record_queries import OPEN, strict_sql
from tallygrid.plans.registry import ORACLES, query


@query(f"""SELECT puzzle_id, pos, voted, 'strict' AS rule FROM (SELECT DISTINCT puzzle_id, pos FROM {OPEN}) LEFT JOIN {strict_sql(OPEN)} USING (puzzle_id, pos)
  UNION ALL SELECT puzzle_id, pos, arg_min(predicted, CASE WHEN predicted IS NOT NULL THEN first - n * 1000 END), 'first_seen' FROM (SELECT puzzle_id, pos, predicted, count(*) AS n, min(attempt) AS first FROM {OPEN} GROUP BY ALL) GROUP BY puzzle_id, pos
  UNION ALL SELECT puzzle_id, pos, arg_min(predicted, CASE WHEN predicted IS NOT NULL THEN predicted - n * 1000 END), 'least' FROM (SELECT puzzle_id, pos, predicted, count(*) AS n FROM {OPEN} GROUP BY ALL) GROUP BY puzzle_id, pos""")
def x2_vote_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each position by every rule."""
    own = fixture(spark, sf_dir, "cells").where("is_clue = 0")
    parts = [plugins.vote(own, ["puzzle_id", "pos"], "predicted", rule) for rule in sorted(plugins.VOTES)]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT image_id, count(*) FILTER (greatest(r, g, b) <= 40) AS walls, count(*) FILTER (r >= 150 AND r - greatest(g, b) >= 70) AS reds FROM {duck('pixels')} GROUP BY 1")
def x3_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plugins.register_sql(spark)
    own = fixture(spark, sf_dir, "pixels")
    return spark.sql("SELECT image_id, count_if(is_wall(r, g, b)) AS walls, count_if(is_maze_red(r, g, b)) AS reds FROM {p} GROUP BY 1", p=own)


@query(f"""SELECT 'option' AS kind, doc_id AS id, reward FROM ({ORACLES['r1_option_reward']}) UNION ALL SELECT 'text', doc_id, reward FROM ({ORACLES['r3_text_reward']}) UNION ALL SELECT 'path', path_id, reward FROM ({ORACLES['r2_path_reward']})""")
def x3_sql_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option, text and path rewards as SQL users call them."""
    plugins.register_sql(spark)
    solved = f"SELECT *, {text_queries.SOL} AS solution FROM {{a}}"
    own = spark.sql(f"SELECT 'option' AS kind, doc_id AS id, reward_option(t, solution) AS reward FROM ({solved}) UNION ALL SELECT 'text', doc_id, reward_text(t, solution) FROM ({solved})", a=fixture(spark, sf_dir, "answers"))
    listed = lambda c: f"concat('[', array_join(transform({c}, x -> string(x)), ', '), ']')"
    ways = spark.sql(f"SELECT 'path' AS kind, path_id AS id, round(reward_path(concat('so <answer>', {listed('pred')}, '</answer>'), {listed('truth')}), 9) AS reward FROM {{p}}", p=text_queries.paths(spark, sf_dir))
    return own.unionByName(ways)


@query("SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'yes' ELSE 'no' END AS response, CAST(NULL AS VARCHAR) AS error, 1 AS attempts FROM documents")
def x5_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    def even(texts: list[str]) -> list[str]:
        return ["yes" if len(t) % 2 == 0 else "no" for t in texts]

    return plugins.call_model(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("request")), even, "doc_id")
