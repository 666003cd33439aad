"""Views over the given tables in the shapes that the operators take, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FIXTURES = {
    "attempts": """
SELECT user_id AS puzzle_id, event_id AS attempt,
  CASE user_id % 3 WHEN 0 THEN 'eyeballing' WHEN 1 THEN 'maze' ELSE 'visual_puzzle' END AS task_group,
  substr('ABCDE', CAST(user_id % 5 AS INT) + 1, 1) AS correct_option,
  substr('ABCDE', CAST(length(event_type) % 5 AS INT) + 1, 1) AS image_option,
  substr('ABCDE', CAST(event_id % 5 AS INT) + 1, 1) AS video_option,
  CASE event_id % 6 WHEN 0 THEN 'the answer is Bravo' WHEN 1 THEN 'I pick a' WHEN 2 THEN ' d ' WHEN 3 THEN 'x-ray then alpha'
    WHEN 4 THEN CASE event_id % 24 WHEN 4 THEN '?' WHEN 10 THEN '7' ELSE '' END ELSE NULL END AS text_option,
  CASE WHEN event_id % 7 < 3 THEN 'Echo, option echo' END AS transcribe_option
FROM {events}""",
    "cells": """
SELECT puzzle_id, attempt, pos, max(is_clue) AS is_clue, max(expected) AS expected, max(predicted) AS predicted FROM (
  SELECT l_suppkey AS puzzle_id, l_partkey % 8 AS attempt, l_linenumber AS pos,
    CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS is_clue,
    1 + (l_suppkey * 7 + l_linenumber) % 9 AS expected,
    CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 15 THEN 1 + (l_suppkey * 7 + l_linenumber) % 9
         ELSE 1 + l_partkey % 9 END AS predicted
  FROM {lineitem}) c
GROUP BY puzzle_id, attempt, pos""",
    "paths": """
SELECT l_orderkey AS path_id, l_linenumber AS pos, l_partkey % 50 AS truth_cell,
  CASE WHEN l_returnflag = 'R' THEN l_partkey % 50 + 1 ELSE l_partkey % 50 END AS pred_cell
FROM {lineitem}""",
    "pixels": """
SELECT image_id, frame_idx, y, x, max(r) AS r, max(g) AS g, max(b) AS b FROM (
  SELECT l_suppkey AS image_id, l_linenumber AS frame_idx, l_partkey % 48 AS y, l_orderkey % 48 AS x,
    (l_partkey * 37 + l_orderkey) % 256 AS r, (l_partkey * 11 + l_suppkey) % 256 AS g, (l_orderkey * 5 + l_linenumber) % 256 AS b
  FROM {lineitem}) p
GROUP BY image_id, frame_idx, y, x""",
    "frames": """
SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, vec_id, embedding AS px FROM {embeddings}""",
    "samples": """
SELECT doc_id AS pos, concat('s', CAST(doc_id % 800 AS VARCHAR(20))) AS id,
  CASE doc_id % 4 WHEN 0 THEN 'maze_square' WHEN 1 THEN 'color_grid' WHEN 2 THEN 'midpoint' ELSE 'unknown_task' END AS task_type,
  CASE WHEN doc_id % 4 = 2 THEN substr('abcde', CAST(doc_id % 5 AS INT) + 1, CASE WHEN doc_id % 50 = 2 THEN 2 ELSE 1 END) END AS correct_option,
  CASE WHEN doc_id % 5 < 4 THEN 1 ELSE 0 END AS has_ti2i, CASE WHEN doc_id % 5 < 3 THEN concat(lang, '  puzzle. Static camera.') WHEN doc_id % 5 = 3 THEN ' ' END AS ti2i_prompt,
  concat('Show ', source, '. In portrait, static camera, no zoom, no pan.') AS prompt,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('puzzles/', CAST(doc_id % 800 AS VARCHAR(20)), '.png') END AS image,
  concat('solutions/', CAST(doc_id AS VARCHAR(20)), '.png') AS solution_image_path
FROM {documents}""",
    "listing": """
SELECT doc_id AS sample_id, concat('preds/', CAST(doc_id AS VARCHAR(20)), '/',
  CASE n WHEN 0 THEN 'zz.png' WHEN 1 THEN 'output.png' WHEN 2 THEN 'generated.png' ELSE 'shot.jpg' END) AS path
FROM (SELECT doc_id, {unnest}({list}(0, 1, 2, 3)) AS n FROM {documents}) d
WHERE (doc_id + n) % 3 <> 0""",
    "retry": """
SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
  CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 1 ELSE 0 END AS ok,
  concat('err-', event_type) AS error
FROM {events}""",
    "judged": """
SELECT d.doc_id AS question_id, CASE WHEN l.quality = 1 THEN 'yes' WHEN l.quality = 0 THEN 'no' ELSE 'error' END AS last_frame_judgment,
  CASE WHEN d.doc_id % 3 = 0 THEN 'yes' WHEN d.doc_id % 3 = 1 THEN 'no' ELSE 'error' END AS audio_judgment,
  CASE WHEN d.doc_id % 13 = 0 THEN 'error' ELSE 'completed' END AS status
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "replies": """
SELECT u.conv_id, u.turn, u.text AS question, a.text AS completion FROM {conversations} u JOIN {conversations} a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'""",
    "answers": """
SELECT doc_id, lang, source, CASE doc_id % 12
  WHEN 0 THEN concat('<answer>', lang, '</answer>') WHEN 1 THEN concat('so <answer>no</answer> then <answer> B </answer> ', source)
  WHEN 2 THEN concat('Answer: ', substr('abcde', CAST(doc_id % 5 AS INT) + 1, 1), '..') WHEN 3 THEN concat('x-ray or Bravo? ', source)
  WHEN 4 THEN concat('I pick a, ', lang) WHEN 5 THEN concat('**', CAST(doc_id % 17 AS VARCHAR(20)), '** of 99 in ', source)
  WHEN 6 THEN concat('<think>red</think> crimson, then gold and ', CASE WHEN doc_id % 2 = 0 THEN 'navy' ELSE 'pink' END, ' scarlet')
  WHEN 7 THEN concat('path [1, 2, ', CAST(doc_id % 7 AS VARCHAR(20)), '] or [3,4,]') WHEN 8 THEN concat('see (https://x.org/', source, ') and (http://y.org)')
  WHEN 9 THEN '  ' WHEN 10 THEN concat('seven or ', CASE WHEN doc_id % 3 = 1 THEN 'twelve' ELSE 'three' END, ' <ANSWER>Yes</ANSWER>') END AS t
FROM {documents}""",
    "triangles": """
SELECT vec_id, {at1} AS ax, {at2} AS ay, {at3} AS bx, {at4} AS by_, {at5} AS cx, {at6} AS cy, {at7} AS dx, {at8} AS dy, label FROM {embeddings}""",
    "candidates": """
SELECT vec_id, label, k AS pos, substr('ABCDE', k + 1, 1) AS name,
  CASE k WHEN 0 THEN {at7} WHEN 1 THEN {at9} WHEN 2 THEN {at11} WHEN 3 THEN {at13} ELSE {at15} END AS x,
  CASE k WHEN 0 THEN {at8} WHEN 1 THEN {at10} WHEN 2 THEN {at12} WHEN 3 THEN {at14} ELSE {at16} END AS y
FROM (SELECT *, {unnest}({list}(0, 1, 2, 3, 4)) AS k FROM {embeddings}) e""",
}

def _at(base: int) -> dict[str, str]:
    """Components of a vector, counted from 1 in the fixtures and from `base` in the engine, scaled to a canvas."""
    return {f"at{k}": f"(256 + 256 * CAST(embedding[{k - 1 + base}] AS DOUBLE))" for k in range(1, 17)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.format(**{t: "{" + t + "}" for t in TABLES}, **_at(0), unnest="explode", list="array"), **used)


def duck(name: str) -> str:
    """The fixture as a DuckDB subquery."""
    return "(" + FIXTURES[name].format(**{t: t for t in TABLES}, **_at(1), unnest="unnest", list="list_value") + ")"
